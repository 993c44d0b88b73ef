"""Configuration, ceilings, limits and typed records."""

import pytest
from pyspark.sql import functions as F

from cairn import config
from cairn.collection import Collection, Limits, Options
from cairn.config import Ceilings, Config
from cairn.errors import CairnError
from cairn.plans.queries import dense
from cairn.plans.records import Record, decode_fp16, encode_fp16
from cairn.schema import PK, SCALARS, VECTORS, CollectionSchema, FieldSchema, IndexParams, VectorSchema

SCHEMA = CollectionSchema(
    "small",
    (FieldSchema("n", "int32"), FieldSchema("big", "uint64", True), FieldSchema("body", "string", True, IndexParams("fts"))),
    (VectorSchema("v", "vector_fp32", 3), VectorSchema("s", "sparse_vector_fp32", 0)),
)


def made(i):
    return Record(f"r{i}").add_int32("n", i).add_string("body", f"word{i} shared").add_vector_fp32("v", [i, 1, 0])


def code_of(call):
    with pytest.raises(CairnError) as e:
        call()
    return e.value.code


def test_configuration():
    assert not config.is_initialized() and config.current() == Config()
    config.initialize(Config(durability="manual", checkpoint_parts=0))
    assert config.is_initialized() and config.current().durability == "manual" and config.current().checkpoint_parts is None
    config.shutdown()
    assert not config.is_initialized() and config.current().durability == "always"
    major, minor, patch = config.VERSION
    assert config.check_version(major, minor, patch) and not config.check_version(major, minor, patch + 1) and not config.check_version(major + 1)
    for wrong in (lambda: Config(io_backend="other"), lambda: Config(durability="never"), lambda: Config(checkpoint_bytes=-1), lambda: Ceilings(snapshot_bytes=0), lambda: Limits(bytes=0)):
        assert code_of(wrong) == "invalid_argument"


def test_records():
    for kind in (*SCALARS, *VECTORS):
        assert hasattr(Record, f"add_{kind}") and hasattr(Record, f"get_{kind}")
    r = made(4).add_uint64("big", 1 << 63).add_sparse_vector_fp32("s", {7: 0.5, 2: 1.0}).set_null("gone")
    assert r.get_int32("n") == 4 and r.get_int64("absent") is None and r.get_string("gone") is None
    assert code_of(lambda: r.get_int64("n")) == code_of(lambda: r.add_int32("n", 1 << 31)) == code_of(lambda: r.set_score(float("nan"))) == "invalid_argument"
    assert r.has("gone") and r.is_null("gone") and not r.is_null("n") and len(r) == 6
    assert r.to_dense("v") == [4.0, 1.0, 0.0] and r.to_dense("s") is None and r.to_sparse("s") == {2: 1.0, 7: 0.5} and r.to_sparse("v") is None
    assert r.dimension("v") == 3 and r.dimension("s") == 8
    assert Record("b").add_vector_binary32("b", bytes(8)).dimension("b") == 64
    wide = Record("w").add_vector_fp64("v", [1e300])
    assert wide.to_dense("v") == [1e300] and wide.to_dense("v", narrow=True) is None
    assert decode_fp16(encode_fp16([1.0, -2.5, 0.1])) == [1.0, -2.5, 0.0999755859375] and encode_fp16([1.0]) == [0x3C00]
    assert code_of(lambda: encode_fp16([1e6])) == "invalid_argument"
    r.remove("gone")
    r.clear()
    assert len(r) == 0


def test_records_in_collections(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), SCHEMA)
    first = made(1).add_uint64("big", (1 << 64) - 1).add_sparse_vector_fp32("s", {3: 2.0})
    assert [w.ok for w in c.insert([first, made(2).set_null("big"), Record("r3").add_int32("n", 3)])] == [True, True, False]
    assert c.update([Record("r2").add_int32("n", 20)])[0].ok
    one, two = (Record.of(row, SCHEMA) for row in c.documents().orderBy(PK).collect())
    assert one.to_dict() == first.to_dict() and one.to_sparse("s") == {3: 2.0}
    assert two.get_int32("n") == 20 and two.is_null("big") and not two.has("s")
    c.close()


def test_limits(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection.create(spark, path, SCHEMA, Options(limits=Limits(documents=3, batch=2)))
    c.insert([made(1), made(2)])
    assert code_of(lambda: c.insert([made(3), made(4), made(5)])) == "resource_exhausted"
    assert code_of(lambda: c.upsert([made(3), made(4)])) == "resource_exhausted"
    assert code_of(lambda: c.upsert_frame(spark.createDataFrame([(f"f{i}", i, [0.0, 0.0, 1.0]) for i in range(2)], f"{PK} string, n int, v array<float>"))) == "resource_exhausted"
    assert c.count() == c.stats()["documents"] == 2
    # What a refused change wrote is gone.
    assert sum(n.startswith(("data-", "gone-")) for n in c._store.names()) == sum(n is not None for part in c._manifest.parts for n in part)
    c.insert([made(3)])
    assert code_of(lambda: c.delete(["r1", "r2", "r3"])) == code_of(lambda: c.delete_by_filter("n >= 1")) == "resource_exhausted"
    assert c.count() == 3
    stored = c._bytes(c._manifest.parts)
    c.close()
    c = Collection.open(spark, path, Options(limits=Limits(bytes=stored + 10)))
    assert code_of(lambda: c.insert([made(4)])) == code_of(lambda: c.rebuild_index("body")) == "resource_exhausted"
    assert [w.ok for w in c.delete(["r1"])] == [True] and c.count() == 2
    c.close()


def test_ceilings_and_checkpoints(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection.create(spark, path, SCHEMA, Options(config=Config(checkpoint_parts=2)))
    for i in range(3):
        c.insert([made(i)])
    assert c.stats()["parts"] == 1 and c.count() == 3
    c.insert([made(3)])
    c.close()
    for ceilings in (Ceilings(snapshot_bytes=10), Ceilings(wal_replay_bytes=10)):
        assert code_of(lambda: Collection.open(spark, path, Options(config=Config(ceilings=ceilings)))) == "resource_exhausted"  # noqa: B023
    config.initialize(Config(ceilings=Ceilings(index_cache_bytes=10)))
    try:
        c = Collection.open(spark, path)  # the refused opening left no lock
    finally:
        config.shutdown()
    assert code_of(lambda: c.rebuild_index("body")) == "resource_exhausted" and c._text_index("body") is None
    c.flush()
    assert c.stats()["parts"] == 1 and c.count() == 4
    c.close()


def test_checkpoints_are_in_index_order(spark, tmp_path):
    schema = CollectionSchema("sorted", (FieldSchema("n", "int32", True, IndexParams("invert")),), (VectorSchema("v", "vector_fp32", 1),))
    c = Collection.create(spark, str(tmp_path / "c"), schema)
    for part in range(2):
        # A third of the rows share a value, some have none.
        rows = [(f"k{part}-{i:03}", None if i % 10 == 9 else 50 if i % 3 == 0 else (7 * i + part) % 100, [float(i)]) for i in range(120)]
        c.upsert_frame(spark.createDataFrame(rows, f"{PK} string, n int, v array<float>"))
    before = sorted(c.documents().select(PK, "n").collect(), key=lambda r: r[PK])
    found = sorted(r[PK] for r in c.query(dense("v", [1.0], 1000).where("n == 50")).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c.flush()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(c.documents().select(PK, "n").collect(), key=lambda r: r[PK]) == before
    assert sorted(r[PK] for r in c.query(dense("v", [1.0], 1000).where("n == 50")).collect()) == found
    files = c.documents().groupBy(F.input_file_name().alias("f")).agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low is not null").orderBy("low", "high").collect()
    assert len(files) > 1 and all(a.high <= b.low for a, b in zip(files, files[1:], strict=False))
    c.close()

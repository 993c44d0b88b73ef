"""Collections and operators on small tables, and registered queries against DuckDB."""

import functools
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cairn import collection_queries, registry
from cairn.collection import Collection, Options
from cairn.errors import CairnError
from cairn.functions import quantize
from cairn.functions.graphs import Graph
from cairn.operators import ann
from cairn.plans.queries import GroupByQuery, MultiQuery, binary, by_id, dense, match, query_string, sparse
from cairn.schema import PK, CollectionSchema, FieldSchema, IndexParams, VectorSchema
from cairn.sources.revisions import Store
from cairn.streaming.ingest import stream_into

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SCHEMA = CollectionSchema(
    "things",
    (FieldSchema("kind", "string", True), FieldSchema("size", "int32"), FieldSchema("body", "string", True, IndexParams("fts")), FieldSchema("tags", "array_string", True)),
    (VectorSchema("v", "vector_fp32", 4), VectorSchema("s", "sparse_vector_fp32", 8), VectorSchema("b", "vector_binary32", 32)),
)


def thing(i):
    doc = {"id": f"d{i:02}", "size": i, "body": f"alpha {'beta ' * (i % 3)}gamma{i % 2}", "tags": ["x", str(i % 2)], "v": [math.sin(i + k) for k in range(4)], "b": bytes([i, 0, 255, i])}
    if i % 3:
        doc["kind"] = "odd" if i % 2 else "even"
    elif i % 2:
        doc["kind"] = None
    if i % 4:
        doc["s"] = {i % 8: 1.0, (i + 3) % 8: 0.5}
    return doc


@pytest.fixture(scope="module")
def things(spark, tmp_path_factory):
    c = Collection.create(spark, str(tmp_path_factory.mktemp("c") / "things"), SCHEMA)
    assert all(r.ok for r in c.insert([thing(i) for i in range(30)]))
    yield c
    c.close()


def ids(df):
    return [r[PK] for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("kind == 'odd'", lambda d: d.get("kind") == "odd"),
        ("kind != 'odd'", lambda d: "kind" in d and d["kind"] != "odd"),
        ("not kind == 'odd'", lambda d: d.get("kind") != "odd"),
        ("kind == null", lambda d: "kind" in d and d["kind"] is None),
        ("kind != null", lambda d: d.get("kind") is not None),
        ("kind in [null, 'even']", lambda d: "kind" in d and d["kind"] in (None, "even")),
        ("kind not in [null]", lambda d: "kind" not in d or d["kind"] is not None),
        ("kind is_null", lambda d: d.get("kind") is None),
        ("size >= 3.5 and size < 9 or id == 'd20'", lambda d: 3.5 <= d["size"] < 9 or d["id"] == "d20"),
        ("size in [1, 2.5, 4]", lambda d: d["size"] in (1, 4)),
        ("size == '3'", lambda d: False),
        ("tags contain_all ['x', '1']", lambda d: d["size"] % 2 == 1),
        ("tags == 'x' or size != 'x' and size < 2", lambda d: d["size"] < 2),
        ("body like '*gamma_' and not body has_suffix '1'", lambda d: d["size"] % 2 == 0),
        ("missing != 1 or not missing == 1 and size < 3", lambda d: d["size"] < 3),
    ],
)
def test_filters(things, text, wanted):
    from cairn.plans import filters

    assert sorted(ids(filters.where(things.documents(), text))) == [d["id"] for d in map(thing, range(30)) if wanted(d)]


def test_vector_routes(things):
    q = [0.1, -0.4, 0.3, 0.9]
    docs = [thing(i) for i in range(30)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    f32 = lambda v: np.array(v, np.float32).astype(float)
    assert ids(things.query(dense("v", q, 5))) == [d["id"] for d in sorted(docs, key=lambda d: (-cos(f32(d["v"]), q), d["id"]))[:5]]
    got = things.query(by_id("v", "d07", 30).within(0.5)).collect()
    assert got[0][PK] == "d07" and all(r._score >= 0.5 for r in got)
    with pytest.raises(CairnError):
        things.query(by_id("s", "d04"))
    best = things.query(sparse("s", {1: 1.0, 4: 2.0}, 3)).collect()
    assert best[0]._score == pytest.approx(max(sum(w * d["s"].get(i, 0) for i, w in ((1, 1.0), (4, 2.0))) / math.sqrt(5 * 1.25) for d in docs if "s" in d))
    ham = lambda d: -sum((x ^ y).bit_count() for x, y in zip(d["b"], b"\x01\x00\xff\x01", strict=True))
    assert [(r[PK], r._score) for r in things.query(binary("b", b"\x01\x00\xff\x01", 6)).collect()] == [(d["id"], ham(d)) for d in sorted(docs, key=lambda d: (-ham(d), d["id"]))[:6]]
    for bad in (dense("v", [1.0]), dense("size", q), dense("v", q).limit(0), dense("v", q).controls(ef=3), sparse("s", {9: 1.0}), match("size", "x")):
        with pytest.raises(CairnError):
            things.query(bad)


def test_text_fusion_groups(things):
    assert set(ids(things.query(query_string("body", "+beta gamma1 -gamma0", 30)))) == {d["id"] for d in map(thing, range(30)) if d["size"] % 3 and d["size"] % 2}
    assert set(ids(things.query(query_string("body", '"beta gamma1"~0', 30)))) == {d["id"] for d in map(thing, range(30)) if d["size"] % 3 and d["size"] % 2}
    assert things.query(match("body", "gamma1 beta", 30, "and").where("size < 9")).count() == 3
    fused = things.multi_query(MultiQuery((dense("v", [1, 0, 0, 0], 5), match("body", "beta", 5)), 4)).collect()
    assert len(fused) == 4 and fused[0]._score <= 2 / 61 + 1e-6
    groups = things.group_by(GroupByQuery(dense("v", [1, 0, 0, 0]), "kind", 3, 2)).collect()
    assert 1 <= len(groups) <= 6 and all(r._key in ('"odd"', '"even"', "__null__") for r in groups)


def test_changes_and_revisions(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection.create(spark, path, SCHEMA)
    assert [r.code for r in c.insert([thing(1), thing(1), {"id": "x"}, thing(2) | {"size": 1 << 31}, thing(3) | {"other": 1}])] == ["", "already_exists", "invalid_argument", "invalid_argument", "invalid_argument"]
    before = c.documents()
    c.upsert([thing(1) | {"size": 9}, thing(4)])
    c.update([{"id": "d04", "size": 44}])
    assert sorted((r[PK], r["size"]) for r in c.documents().collect()) == [("d01", 9), ("d04", 44)]
    assert [r["size"] for r in before.collect()] == [1]  # a reader keeps its revision
    with pytest.raises(CairnError):
        Collection.open(spark, path)
    reader = Collection.open(spark, path, Options(read_only=True))
    assert reader.count() == 2
    with pytest.raises(CairnError):
        reader.delete(["d01"])
    assert [r.ok for r in c.delete(["d01", "none"])] == [True, False]
    c.add_column(FieldSchema("n", "int64", True), "5")
    c.alter_column(FieldSchema("n", "int64", False))
    c.flush()
    assert c.fetch(["d04", "d04", "d01"]).select("n").collect() == [(5,), (5,)]
    c.close()
    c = Collection.open(spark, path)
    assert [r[PK] for r in c.iter()] == ["d04"] and c.stats()["documents"] == 1
    c.destroy()


def test_stored_postings_equal_the_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["red", "green", "blue", "bluet", "rd", "deep", "deeper", "sea", "seas", "sky"]
    texts = [None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for i in range(90)]
    c = Collection.create(spark, str(tmp_path / "t"), CollectionSchema("t", (FieldSchema("body", "string", True), FieldSchema("n", "int32"))))
    c.upsert_frame(spark.createDataFrame([(f"k{i}", t, i) for i, t in enumerate(texts)], f"{PK} string, body string, n int"))
    queries = ["red blue -sea", '"sea deep"~3 +sky', "de*p* s?a", "blue~1 [blue TO green}", "(red OR sky) AND deep NOT blue~1", "red^3 absent", "* -red"]
    asked = [query_string("body", q, 50, operator).where(w) for q, operator, w in zip(queries, ["or", "and"] * 4, [None, None, "n < 60"] * 3, strict=False)]
    shown = lambda: [[(r[PK], r["_score"]) for r in c.query(q).collect()] for q in asked]
    scans = shown()
    c.create_index("body", IndexParams("fts"))
    assert c._text_index("body") is not None and shown() == scans and sum(map(len, scans)) > 100
    c.delete(["k1", "k2", "absent"])
    c.upsert([{"id": "k3", "body": "deep blue sea", "n": 3}, {"id": "new", "body": "red skyline sea", "n": 200}, {"id": "k4", "body": None, "n": 4}])
    c.delete(["new", "k5"])
    c.insert([{"id": "new", "body": "blues sky red", "n": 1}, {"id": "none", "body": "", "n": 2}])
    overlaid = shown()  # the stored postings with four changes laid over them
    folder, covered = c._covering("body")
    assert covered < len(c._manifest.parts)
    c._store.delete(f"{folder}/_ready")
    assert c._text_index("body") is None and shown() == overlaid != scans
    c.destroy()


def test_vector_indexes_stay_in_use_after_changes(spark, tmp_path):
    rng = np.random.default_rng(5)
    row = lambda i: {"id": f"k{i}", "v": [float(x) for x in rng.normal(size=8)]}
    for kind, controls in (("ivf", {"nprobe": 4}), ("hnsw", {"ef": 1000})):
        schema = CollectionSchema("v", (), (VectorSchema("v", "vector_fp32", 8, IndexParams(kind, {"n_lists": 4} if kind == "ivf" else {})),))
        c = Collection.create(spark, str(tmp_path / kind), schema)
        c.insert([row(i) for i in range(80)])
        c.rebuild_index("v")
        c.delete([f"k{i}" for i in range(10)])
        c.upsert([row(i) for i in range(5, 25)])
        c.insert([row(i) for i in range(100, 110)])
        _, covered = c._covering("v")
        assert covered < len(c._manifest.parts)
        for _ in range(3):
            q = dense("v", [float(x) for x in rng.normal(size=8)], 12)
            shown = lambda q, c=c: [(r[PK], r["_score"]) for r in c.query(q).collect()]
            exact = shown(q.controls(is_linear=True))
            assert shown(q.controls(**controls)) == exact and len(exact) == 12
        assert c.stats().get("fallbacks", 0) == 0
        c.flush()
        assert c._covering("v") is None
        c.destroy()


def test_a_pinned_revision_survives_changes_and_flush(spark, tmp_path):
    path = str(tmp_path / "p")
    c = Collection.create(spark, path, CollectionSchema("p", (FieldSchema("n", "int64"),)))
    c.insert([{"id": str(i), "n": i} for i in range(5)])
    reader = Collection.open(spark, path, Options(read_only=True))
    lazy = reader.documents()
    for k in range(3):
        c.upsert([{"id": str(k), "n": 10 + k}, {"id": f"new{k}", "n": 7}])
        c.delete([str(4 - k)])
        c.flush()
    assert sorted(r["n"] for r in lazy.collect()) == [0, 1, 2, 3, 4] and reader.count() == 5
    assert c.count() == Collection.open(spark, path, Options(read_only=True)).count() == 5
    c.vacuum()
    assert reader.count() == 5  # younger than the time they are kept
    c.vacuum(0)
    assert sorted(r["n"] for r in c.documents().collect()) == [7, 7, 7, 10, 11] and len([n for n in c._store.names() if n.startswith("data-")]) == 1
    c.destroy()


def test_stream(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "s"), CollectionSchema("s", (FieldSchema("n", "int64"),)))
    for k in range(2):
        spark.range(5 * k, 5 * k + 7).select(F.col("id").cast("string").alias(PK), F.lit(k).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{PK} string, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_into(stream, c, str(tmp_path / "ck")).awaitTermination(120)
    assert c.count() == 12
    c.close()


def test_quantizers_and_graphs():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (800, 32))
    queries = rng.normal(0, 1, (20, 32))
    for metric in ("l2", "ip", "cosine"):
        exact = [set(np.argsort(-quantize.metric_scores(x, q, metric), kind="stable")[:10]) for q in queries]
        pq = quantize.ProductQuantizer.train(x, 8, 3)
        codes = pq.encode(x)
        coder = quantize.RaBitQ(x.mean(0), 7)
        packed = coder.encode(x)
        norms = (x * x).sum(1)
        for layered in (True, False):
            g = Graph.build(x, metric, 16, 64, layered, 1.2)
            found = [len(exact[i] & {j for _, j in g.search(x, q, metric, 100)[:10]}) for i, q in enumerate(queries)]
            assert np.mean(found) >= 9, (metric, layered)
            assert {j for _, j in g.search(x, queries[0], metric, 800)[:10]} == exact[0]
        assert np.mean([len(exact[i] & set(np.argsort(-coder.scores(*packed, norms, q, metric))[:10])) for i, q in enumerate(queries)]) >= 9
        assert np.mean([len(exact[i] & set(np.argsort(-pq.scores(codes, q, metric))[:60])) for i, q in enumerate(queries)]) >= 7


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_bounded_queries_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias(PK), F.col("embedding").alias("v")).cache()
    found = rows.collect()
    x, at = np.array([r.v for r in found], np.float64), {r[PK]: i for i, r in enumerate(found)}
    probes = [k for k in at if int(k) % 100 == 0]
    for name, kind, params, controls in collection_queries.BOUNDED:
        index, store = IndexParams(kind, params), Store(spark, str(tmp_path / name))
        ann.build(store, "index", rows, index)
        near = [ann.candidates(ann.load(store, "index"), index, x[at[k]], index["metric"], 10, controls, None).select(F.lit(k).alias("probe"), PK) for k in probes]
        held = {k: set() for k in probes}
        for r in functools.reduce(lambda a, b: a.union(b), near).collect():
            held[r.probe].add(at[r[PK]])
        hits = 0
        for k in probes:  # the probe itself does not count
            best = [i for i in np.argsort(-quantize.metric_scores(x, x[at[k]], index["metric"]), kind="stable") if i != at[k]]
            hits += len(set(best[:10]) & held[k])
        assert hits >= 9 * len(probes), (name, hits / 10 / len(probes))


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(__spark_entry__.queries())
    for name in ("dense_l2", "dense_radius_cosine", "sparse_cosine", "binary_hamming", "filter_bool", "filter_absent", "tok_standard", "bm25_boolean", "phrase_slop", "wildcard", "rrf", "weighted_zscore", "group_by_topk", "update", "ivf_exhaustive"):
        df, sql = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
        got, wanted = plain(df.collect(), df.columns), plain(sql.fetchall(), sql.columns)
        assert got == wanted and sorted(df.columns) == sorted(sql.columns), name

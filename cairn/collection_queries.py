"""Registered queries that go through collections: changes, fetches and approximate indexes."""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.collection import Collection
from cairn.plans.queries import dense, query_string
from cairn.registry import ORACLE_SQL, _add, _dense_sql, _probe, _table
from cairn.schema import PK, CollectionSchema, FieldSchema, IndexParams, VectorSchema


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared scratch space. Where none is set only a session in one process gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp()}/collections/{uuid.uuid4().hex}"


def _embeddings(spark: SparkSession, sf_dir: str, index: IndexParams | None = None) -> Collection:
    schema = CollectionSchema("embeddings", (FieldSchema("label", "int32", True),), (VectorSchema("embedding", "vector_fp32", 64, index),))
    c = Collection.create(spark, _folder(spark), schema)
    c.upsert_frame(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias(PK), "label", "embedding"), insert_only=True)
    return c


def _near(kind: str, params: dict, controls: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search through an index; at exhaustive settings its results are the exact ones."""
    c = _embeddings(spark, sf_dir)
    c.create_index("embedding", IndexParams(kind, params))
    probe = _probe(_table(spark, sf_dir, "embeddings"))
    out = c.query(dense("embedding", probe, 10).controls(**controls))
    c.close()
    return out.select(F.col(PK).cast("long").alias("vec_id"), F.round(F.col("_score").cast("double") + 0.0, 4).alias("score"))


def _near_sql(metric: str) -> str:
    return _dense_sql(metric).replace("round(s + 0.0, 6)", "round(s::FLOAT::DOUBLE + 0.0, 4)").replace("s DESC, vec_id", "s DESC, vec_id::VARCHAR")


for _name, _kind, _params, _controls in (
    ("ivf_exhaustive", "ivf", {"n_lists": 8}, {"nprobe": 8}),
    ("ivf_soar_exhaustive", "ivf", {"n_lists": 8, "use_soar": True, "quantize": "int8"}, {"nprobe": 8, "scale_factor": 1e6}),
    ("ivf_rabitq_exhaustive", "ivf_rabitq", {"n_lists": 8}, {"nprobe": 8, "scale_factor": 1e6}),
    ("hnsw_exhaustive", "hnsw", {}, {"ef": 1_000_000}),
    ("hnsw_rabitq_exhaustive", "hnsw_rabitq", {}, {"ef": 1_000_000}),
    ("vamana_exhaustive", "vamana", {"metric": "l2"}, {"list_size": 1_000_000}),
    ("pq_exhaustive", "diskann", {"metric": "l2", "pq_chunk_num": 8}, {"list_size": 1_000_000}),
):
    _add(_name, partial(_near, _kind, _params, _controls), _near_sql(_params.get("metric", "cosine")))
#: Searches that read a part of the index only: their results are approximate, so they have no SQL.
BOUNDED = (
    ("hnsw_bounded", "hnsw", {}, {"ef": 64}),
    ("ivf_bounded", "ivf", {"n_lists": 16}, {"nprobe": 12}),
    ("ivf_rabitq_bounded", "ivf_rabitq", {"n_lists": 16}, {"nprobe": 12}),
    ("hnsw_rabitq_bounded", "hnsw_rabitq", {}, {"ef": 64}),
    ("vamana_bounded", "vamana", {"metric": "l2"}, {"list_size": 64}),
    ("pq_bounded", "diskann", {"metric": "l2", "pq_chunk_num": 8}, {"list_size": 128}),
)
for _name, _kind, _params, _controls in BOUNDED:
    _add(_name, partial(_near, _kind, _params, _controls))


def _indexed(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured query answered from the stored postings of a collection."""
    fields = (FieldSchema("text", "string", True), FieldSchema("lang", "string", True))
    c = Collection.create(spark, _folder(spark), CollectionSchema("documents", fields))
    c.upsert_frame(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(PK), "text", "lang"), insert_only=True)
    c.create_index("text", IndexParams("fts"))
    out = c.query(query_string("text", text, 20))
    c.close()
    return out.select(F.col(PK).cast("long").alias("doc_id"), F.round(F.col("_score").cast("double") + 0.0, 4).alias("score"))


for _name, _text in (
    ("bm25_or", "erea thanea idiot"), ("bm25_must_not", "+erea the -of"), ("bm25_boolean", "(erea OR idiot) AND the NOT that"),
    ("phrase", '"of the"'), ("phrase_slop", '"of the"~2'), ("wildcard", "idi?t clo*n"), ("term_range", "[clown TO cloz}"), ("fuzzy", "idoit~1"),
):
    _scan = ORACLE_SQL[_name].replace("round(s + 0.0, 6)", "round(s::FLOAT::DOUBLE + 0.0, 4)").replace("s DESC, doc_id LIMIT", "s DESC, doc_id::VARCHAR LIMIT")
    _add(f"{_name}_indexed", partial(_indexed, _text), _scan)


def _overlaid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after changes that the stored postings do not hold."""
    fields = (FieldSchema("text", "string", True), FieldSchema("lang", "string", True))
    c = Collection.create(spark, _folder(spark), CollectionSchema("documents", fields))
    c.upsert_frame(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias(PK), "text", "lang"), insert_only=True)
    c.create_index("text", IndexParams("fts"))
    c.delete(["1", "2", "3"])
    c.upsert([{"id": "5", "text": "erea thanea", "lang": "en"}, {"id": "900001", "text": "idiot erea", "lang": "en"}])
    out = c.query(query_string("text", "erea thanea idiot", 20))
    c.close()
    return out.select(F.col(PK).cast("long").alias("doc_id"), F.round(F.col("_score").cast("double") + 0.0, 4).alias("score"))


_CHANGED = "FROM (SELECT doc_id, lang, text FROM documents WHERE doc_id NOT IN (1, 2, 3, 5) UNION ALL SELECT 5, 'en', 'erea thanea' UNION ALL SELECT 900001, 'en', 'idiot erea')"
_add("bm25_or_overlaid", _overlaid_text, ORACLE_SQL["bm25_or_indexed"].replace("FROM documents", _CHANGED))


def _overlaid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search through an index after a delete and an update that it does not hold."""
    c = _embeddings(spark, sf_dir)
    c.create_index("embedding", IndexParams("ivf", {"n_lists": 8}))
    probe = _probe(_table(spark, sf_dir, "embeddings"))
    c.delete(["10", "11", "12"])
    c.upsert([{"id": "13", "label": 0, "embedding": probe}])
    out = c.query(dense("embedding", probe, 10).controls(nprobe=8))
    c.close()
    return out.select(F.col(PK).cast("long").alias("vec_id"), F.round(F.col("_score").cast("double") + 0.0, 4).alias("score"))


_FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_MOVED = f"(SELECT vec_id, CASE WHEN vec_id = 13 THEN {_FIRST} ELSE embedding END AS embedding, label FROM embeddings WHERE vec_id NOT IN (10, 11, 12)) e"
_add("ivf_overlaid", _overlaid_vectors, _near_sql("cosine").replace("(SELECT vec_id, embedding, label FROM embeddings) e", _MOVED))


def _customers(spark: SparkSession, sf_dir: str) -> Collection:
    fields = (FieldSchema("c_name", "string"), FieldSchema("c_nationkey", "int32", True), FieldSchema("c_acctbal", "double", True))
    c = Collection.create(spark, _folder(spark), CollectionSchema("customer", fields))
    c.upsert_frame(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias(PK), "c_name", "c_nationkey", "c_acctbal"), insert_only=True)
    return c


def _shown(c: Collection) -> DataFrame:
    out = c.documents().select(F.col(PK).alias("id"), "c_name", "c_nationkey", "c_acctbal")
    c.close()
    return out


_CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_nationkey, c_acctbal FROM customer"


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    c.insert([{"id": "new", "c_name": "N", "c_nationkey": 3}, {"id": "1", "c_name": "refused"}, {"id": "new", "c_name": "refused"}])
    return _shown(c)


def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    c.update([{"id": "1", "c_acctbal": 5.5}, {"id": "2", "c_nationkey": None}, {"id": "none", "c_acctbal": 1.0}])
    return _shown(c)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    c.upsert([{"id": "1", "c_name": "one"}, {"id": "x", "c_name": "two", "c_acctbal": 2.0}])
    return _shown(c)


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    c.delete(["1", "2", "absent"])
    c.delete_by_filter("c_nationkey in [3, 4] and c_acctbal < 0")
    c.flush()
    return _shown(c)


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    c.add_column(FieldSchema("tier", "string", True), "'basic'")
    c.rename_column("c_acctbal", "balance")
    c.drop_column("c_nationkey")
    out = c.documents().select(F.col(PK).alias("id"), "c_name", "balance", "tier")
    c.close()
    return out


def _fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    out = c.fetch(["7", "3", "absent", "7"]).select(F.col(PK).alias("id"), "c_name")
    c.close()
    return out


def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    out = c.documents().agg(F.count("*").alias("documents"))
    c.close()
    return out


def _ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    out = c.with_ordinals(c.documents()).select(F.col(PK).alias("id"), F.col("_doc_id").cast("long").alias("doc_id"))
    c.close()
    return out


_add("insert", _insert, f"{_CUSTOMER} UNION ALL SELECT 'new', 'N', 3, NULL")
_add("update", _update, "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, CASE WHEN c_custkey = 2 THEN NULL ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey = 1 THEN 5.5 ELSE c_acctbal END AS c_acctbal FROM customer")
_add("upsert", _upsert, f"{_CUSTOMER} WHERE c_custkey <> 1 UNION ALL SELECT '1', 'one', NULL, NULL UNION ALL SELECT 'x', 'two', NULL, 2.0")
_add("delete", _delete, f"{_CUSTOMER} WHERE c_custkey NOT IN (1, 2) AND NOT coalesce(c_nationkey IN (3, 4) AND c_acctbal < 0, false)")
_add("alter_columns", _columns, "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_acctbal AS balance, 'basic' AS tier FROM customer")
_add("fetch", _fetch, "SELECT id, c_name FROM (VALUES ('7'), ('3'), ('7')) AS a(id) JOIN (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer) USING (id)")
_add("count", _count, "SELECT count(*) AS documents FROM customer")
_add("doc_id", _ordinal, "SELECT CAST(c_custkey AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS doc_id FROM customer")

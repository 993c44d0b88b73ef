"""Registered queries of the engine's own operators and the DuckDB SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.analysis import Analyzer
from cairn.functions.scoring import radius_floor
from cairn.operators import fts, fusion
from cairn.operators import vector as vectors
from cairn.plans import filters, query_string

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _rounded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.round(F.col("_score") + 0.0, 6).alias("score"))


# Dense vectors: the query is the vector of the smallest id.

_SQL_SCORE = {
    "l2": "-list_sum([(a - b) * (a - b) FOR a, b IN zip])",
    "ip": "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "mips_l2": "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "cosine": "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
}
_SQL_SCORE["l2"] = "-pow(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 2)"
_EMB = "(SELECT vec_id, embedding, label FROM embeddings) e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q"


def _probe(df: DataFrame) -> list[float]:
    first = df.agg(F.min_by("embedding", "vec_id").alias("v")).first()
    return list(first.v)


def _dense(metric: str, spark: SparkSession, sf_dir: str, where: str | None = None, radius: float | None = None, k: int = 10) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    scored = vectors.scored_dense(filters.where(df, where, "vec_id"), "embedding", _probe(df), metric)
    return _rounded(vectors.top(scored, k, "vec_id", None if radius is None else radius_floor(metric, radius)), "vec_id")


def _dense_sql(metric: str, where: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id, round(s + 0.0, 6) AS score FROM (SELECT vec_id, {_SQL_SCORE[metric]} AS s FROM {_EMB} WHERE {where}) WHERE {{floor}} ORDER BY s DESC, vec_id LIMIT {k}".replace("WHERE {floor}", "")


for _metric in ("l2", "ip", "cosine", "mips_l2"):
    _add(f"dense_{_metric}", partial(_dense, _metric), _dense_sql(_metric))
_add("dense_filtered", partial(_dense, "cosine", where="label in [1, 3, 5] and not label == 3"), _dense_sql("cosine", "label IN (1, 5)"))
_add("dense_radius_l2", partial(_dense, "l2", radius=1.3, k=1_000_000), _dense_sql("l2", "pow(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 2) <= 1.3 * 1.3", 1_000_000))
_add("dense_radius_cosine", partial(_dense, "cosine", radius=0.2, k=1_000_000), _dense_sql("cosine", "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.2", 1_000_000))


def _by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    probe = vectors.stored_vector(df, "embedding", 7, "vec_id")
    return _rounded(vectors.top(vectors.scored_dense(df, "embedding", list(probe), "ip"), 10, "vec_id"), "vec_id")


_add("dense_by_id", _by_id, "SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 0.0, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")

# Sparse vectors: coordinates beyond 0.1 in magnitude; the query is the first row's.


def _sparse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    kept = F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("x"))), lambda p: F.abs(p["x"].cast("double")) > 0.1)
    return df.select("vec_id", F.struct(F.transform(kept, lambda p: p["i"]).alias("indices"), F.transform(kept, lambda p: p["x"]).alias("values")).alias("v"))


def _sparse(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sparse_table(spark, sf_dir)
    probe = df.agg(F.min_by("v", "vec_id").alias("v")).first().v
    items = dict(zip(probe["indices"], probe["values"], strict=True))
    return _rounded(vectors.top(vectors.scored_sparse(df, "v", items, metric), 10, "vec_id"), "vec_id")


_SPARSE_SQL = """
WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE abs(embedding[i]::DOUBLE) > 0.1),
q AS (SELECT i, x AS y FROM x WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
d AS (SELECT x.vec_id, sum(x * y) AS dot FROM x JOIN q USING (i) GROUP BY ALL),
n AS (SELECT vec_id, sum(x * x) AS sq FROM x GROUP BY ALL),
s AS (SELECT e.vec_id, coalesce(dot, 0.0) AS dot, coalesce(sq, 0.0) AS sq, (SELECT sum(y * y) FROM q) AS qq FROM embeddings e LEFT JOIN d USING (vec_id) LEFT JOIN n USING (vec_id)),
r AS (SELECT vec_id, {score} AS s FROM s)
SELECT vec_id, round(s + 0.0, 6) AS score FROM r ORDER BY s DESC, vec_id LIMIT 10
"""
for _metric, _score in (("ip", "dot"), ("l2", "-(sq + qq - 2 * dot)"), ("cosine", "CASE WHEN sq = 0 OR qq = 0 THEN 0.0 ELSE dot / (sqrt(sq) * sqrt(qq)) END")):
    _add(f"sparse_{_metric}", partial(_sparse, _metric), _SPARSE_SQL.format(score=_score))

# Binary vectors: the signs of the 64 coordinates.


def _binary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    pack = lambda at: F.lpad(F.conv(F.substring(bits, at, 32), 2, 16), 8, "0")
    return df.select("vec_id", F.unhex(F.concat(pack(1), pack(33))).alias("bits"))


def _binary(spark: SparkSession, sf_dir: str, radius: float | None = None, k: int = 10) -> DataFrame:
    df = _binary_table(spark, sf_dir)
    probe = bytes(df.agg(F.min_by("bits", "vec_id").alias("b")).first().b)
    scored = vectors.scored_binary(df, "bits", probe)
    return vectors.top(scored, k, "vec_id", None if radius is None else radius_floor("l2", radius)).select("vec_id", F.col("_score").alias("score"))


_BINARY_SQL = """
WITH s AS (SELECT e.vec_id, -CAST(len([1 FOR i IN range(1, 65) IF (e.embedding[i] > 0) <> (q.embedding[i] > 0)]) AS DOUBLE) + 0.0 AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q)
SELECT vec_id, score FROM s {where} ORDER BY score DESC, vec_id {limit}
"""
_add("binary_hamming", _binary, _BINARY_SQL.format(where="", limit="LIMIT 10"))
_add("binary_radius", partial(_binary, radius=5.0, k=1_000_000), _BINARY_SQL.format(where="WHERE score >= -25", limit=""))

# The filter language.

_FILTERS: list[tuple[str, str, str, str, str]] = [
    ("filter_eq", "orders", "o_orderkey", "o_orderstatus == 'F'", "o_orderstatus = 'F'"),
    ("filter_ne", "orders", "o_orderkey", "o_orderstatus != 'F'", "o_orderstatus <> 'F'"),
    ("filter_range", "orders", "o_orderkey", "o_totalprice >= 1000 and o_totalprice < 150000.5", "o_totalprice >= 1000 AND o_totalprice < 150000.5"),
    ("filter_in", "part", "p_partkey", "p_size in [1, 5, 9]", "p_size IN (1, 5, 9)"),
    ("filter_not_in", "part", "p_partkey", "p_brand not in ['Brand#1', 'Brand#12']", "p_brand NOT IN ('Brand#1', 'Brand#12')"),
    ("filter_like", "part", "p_partkey", "p_type like '*CON*Y' or p_name like 'b_ue%t'", "p_type LIKE '%CON%Y' OR p_name LIKE 'b_ue%t'"),
    ("filter_prefix", "customer", "c_custkey", "c_mktsegment has_prefix 'B'", "starts_with(c_mktsegment, 'B')"),
    ("filter_suffix", "customer", "c_custkey", "not c_name has_suffix '7'", "NOT ends_with(c_name, '7')"),
    ("filter_bool", "orders", "o_orderkey", "not (o_orderstatus = 'O' || o_custkey < 50) && o_totalprice > 100000", "NOT (o_orderstatus = 'O' OR o_custkey < 50) AND o_totalprice > 100000"),
    ("filter_pk", "orders", "o_orderkey", "id <= 100", "o_orderkey <= 100"),
    ("filter_mismatch", "orders", "o_orderkey", "o_orderstatus != 5 and not o_orderstatus > 5", "true"),
]


def _filtered(table: str, key: str, text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.where(_table(spark, sf_dir, table), text, key).select(key)


for _name, _tab, _key, _text, _sql in _FILTERS:
    _add(_name, partial(_filtered, _tab, _key, _text), f"SELECT {_key} FROM {_tab} WHERE {_sql}")


def _labelled(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.where(docs, text, "doc_id").select("doc_id")


_LEFT = "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE "
_add("filter_is_null", partial(_labelled, "toxic is_null"), _LEFT + "toxic IS NULL")
_add("filter_absent", partial(_labelled, "toxic != 1"), _LEFT + "coalesce(toxic <> 1, false)")
_add("filter_not_absent", partial(_labelled, "not toxic == 1"), _LEFT + "NOT coalesce(toxic = 1, false)")


def _contain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part").withColumn("tags", F.split("p_type", " "))
    return filters.where(df.withColumn("tags", F.array_append("tags", F.col("p_brand"))), "tags contain_all ['Brand#1'] or tags contain_all []  and p_size < 3", "p_partkey").select("p_partkey")


_add("filter_contain_all", _contain_all, "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'Brand#1') OR p_brand = 'Brand#1' OR p_size < 3")

# Full text.

_STANDARD = Analyzer()
_SQL_TOKENS = r"[x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> '']"


def _tokens(analyzer: Analyzer, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", analyzer.column(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n"), F.array_min("t").alias("least"), F.array_max("t").alias("most"))


def _tokens_sql(expression: str) -> str:
    return f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, list_min(t) AS least, list_max(t) AS most FROM (SELECT doc_id, {expression} AS t FROM documents)"


_add("tok_standard", partial(_tokens, _STANDARD), _tokens_sql(_SQL_TOKENS))
_add("tok_whitespace", partial(_tokens, Analyzer("whitespace", ())), _tokens_sql(r"[x FOR x IN regexp_split_to_array(text, '[\s]+') IF x <> '']"))
_add("tok_ngram", partial(_tokens, Analyzer("ngram", (), {"ngram_min": 2, "ngram_max": 3})), _tokens_sql("[text[i : i + 1] FOR i IN range(1, length(text))] || [text[i : i + 2] FOR i IN range(1, length(text) - 1)]"))
_add("tok_folded", partial(_tokens, Analyzer("standard", ("lowercase", "ascii_folding", "stemmer"))))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.vocabulary(_table(spark, sf_dir, "documents"), "text", _STANDARD)


_add("df_vocab", _vocabulary, f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_SQL_TOKENS})) AS term FROM documents) GROUP BY term")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.postings(_table(spark, sf_dir, "documents"), "text", _STANDARD, "doc_id").groupBy("doc_id", "dl").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


_add("postings", _postings, f"SELECT doc_id, CAST(len(t) AS INTEGER) AS dl, len(list_distinct(t)) AS terms, CAST(len(t) AS BIGINT) AS tokens FROM (SELECT doc_id, {_SQL_TOKENS} AS t FROM documents) WHERE len(t) > 0")


def _bm25(text: str, spark: SparkSession, sf_dir: str, operator: str = "or", where: str | None = None, structured: bool = False, k: int = 20) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tree = query_string.parse(text, _STANDARD, "text", operator) if structured else query_string.match_terms(text, _STANDARD, operator)
    found = fts.search(docs, filters.where(docs, where, "doc_id"), "text", tree, _STANDARD, "doc_id")
    return _rounded(vectors.top(found, k, "doc_id"), "doc_id")


def _bm25_sql(weights: dict[str, float], where: str = "true", k: int = 20) -> str:
    terms = ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in weights.items())
    return f"""
WITH t AS (SELECT doc_id, lang, {_SQL_TOKENS} AS t FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(t)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS a FROM t),
q AS (SELECT * FROM (VALUES {terms}) AS v(term, w)),
f AS (SELECT doc_id, lang, t, CAST(len(t) AS DOUBLE) AS dl, term, w, CAST(len([x FOR x IN t IF x = term]) AS DOUBLE) AS tf FROM t, q),
d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM f WHERE tf > 0 GROUP BY term),
r AS (SELECT doc_id, any_value(lang) AS lang, any_value(t) AS t, any_value(dl) AS dl, count(CASE WHEN tf > 0 THEN 1 END) AS hits,
  sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s
  FROM f JOIN d USING (term), s GROUP BY doc_id)
SELECT doc_id, round(s + 0.0, 6) AS score FROM r WHERE s > 0 AND ({where}) ORDER BY s DESC, doc_id LIMIT {k}
"""


_TWO = {"thion": 1.0, "thanea": 1.0}
_WORDS3 = {"erea": 1.0, "thanea": 1.0, "idiot": 1.0}
_add("bm25_or", partial(_bm25, "erea thanea idiot"), _bm25_sql(_WORDS3))
_add("bm25_and", partial(_bm25, "the erea and", operator="and"), _bm25_sql({"the": 1.0, "erea": 1.0, "and": 1.0}, "hits = 3"))
_add("bm25_filtered", partial(_bm25, "la erea de", where="lang == 'fr' or lang == 'es'"), _bm25_sql({"la": 1.0, "erea": 1.0, "de": 1.0}, "lang IN ('fr', 'es')"))
_add("bm25_must_not", partial(_bm25, "+erea the -of", structured=True), _bm25_sql({"erea": 1.0, "the": 1.0}, "list_contains(t, 'erea') AND NOT list_contains(t, 'of')"))
_add("bm25_boost", partial(_bm25, "erea^2.5 idiot", structured=True), _bm25_sql({"erea": 2.5, "idiot": 1.0}))
_add("bm25_boolean", partial(_bm25, "(erea OR idiot) AND the NOT that", structured=True), _bm25_sql({"erea": 1.0, "idiot": 1.0, "the": 1.0}, "(list_contains(t, 'erea') OR list_contains(t, 'idiot')) AND list_contains(t, 'the') AND NOT list_contains(t, 'that')"))
_add("phrase", partial(_bm25, '"of the"', structured=True), _bm25_sql({"of": 1.0, "the": 1.0}, "len([1 FOR i IN range(1, len(t)) IF t[i] = 'of' AND t[i + 1] = 'the']) > 0"))
_add("phrase_slop", partial(_bm25, '"of the"~2', structured=True), _bm25_sql({"of": 1.0, "the": 1.0}, "len([1 FOR i IN range(1, len(t)) IF t[i] = 'of' AND list_contains(t[i + 1 : i + 3], 'the')]) > 0"))


def _vocabulary_sql(condition: str, k: int = 20) -> str:
    return f"""
WITH t AS (SELECT doc_id, {_SQL_TOKENS} AS t FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(t)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS a FROM t),
f AS (SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl, unnest(t) AS term FROM t) WHERE {condition} GROUP BY ALL),
d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM f GROUP BY term),
r AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM f JOIN d USING (term), s GROUP BY doc_id)
SELECT doc_id, round(s + 0.0, 6) AS score FROM r WHERE s > 0 ORDER BY s DESC, doc_id LIMIT {k}
"""


_add("wildcard", partial(_bm25, "idi?t clo*n", structured=True), _vocabulary_sql("term LIKE 'idi_t' OR term LIKE 'clo%n'"))
_add("term_range", partial(_bm25, "[clown TO cloz}", structured=True), _vocabulary_sql("term >= 'clown' AND term < 'cloz'"))
_add("fuzzy", partial(_bm25, "idoit~1", structured=True), _vocabulary_sql("damerau_levenshtein(term, 'idoit') <= 1"))
_add("match_all", partial(_bm25, "*", structured=True), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 20")

# Fusion and groups: two dense routes (cosine to the first vector, inner product with vector 7).


def _routes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    df = _table(spark, sf_dir, "embeddings")
    probes = [(_probe(df), "cosine"), (list(vectors.stored_vector(df, "embedding", 7, "vec_id")), "ip")]
    return [vectors.narrowed(vectors.top(vectors.scored_dense(df, "embedding", p, m), 30, "vec_id").select("vec_id", "_score")) for p, m in probes]


def _fused(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return vectors.top(fusion.fused(_routes(spark, sf_dir), "vec_id", **how), 10, "vec_id").select("vec_id", F.round(F.col("_score").cast("double") + 0.0, 5).alias("score"))


def _fused_sql(part: str) -> str:
    branch = lambda b, w, s, q: f"(SELECT {b} AS b, {w}::DOUBLE AS w, e.vec_id, {s}::FLOAT::DOUBLE AS s FROM embeddings e, embeddings q WHERE q.vec_id = {q} ORDER BY {s} DESC, e.vec_id LIMIT 30)"
    one = branch(0, 2.0, _SQL_SCORE["cosine"], "(SELECT min(vec_id) FROM embeddings)")
    two = branch(1, 1.0, _SQL_SCORE["ip"], 7)
    return f"""
WITH x AS ({one} UNION ALL {two}),
p AS (SELECT vec_id, {part} AS p FROM x),
f AS (SELECT vec_id, sum(p)::FLOAT AS s FROM p GROUP BY vec_id)
SELECT vec_id, round(s::DOUBLE + 0.0, 5) AS score FROM f ORDER BY s DESC, vec_id LIMIT 10
"""


_add("rrf", partial(_fused, method="rrf"), _fused_sql("1.0::DOUBLE / (60.0::DOUBLE + row_number() OVER (PARTITION BY b ORDER BY s DESC, vec_id))"))
_add("weighted", partial(_fused, method="weighted", weights=[2.0]), _fused_sql("w * s"))
_add("weighted_minmax", partial(_fused, method="weighted", weights=[2.0], normalize="minmax"), _fused_sql("w * (s - min(s) OVER (PARTITION BY b)) / greatest(max(s) OVER (PARTITION BY b) - min(s) OVER (PARTITION BY b), 1e-12)"))
_add("weighted_zscore", partial(_fused, method="weighted", weights=[2.0], normalize="zscore"), _fused_sql("w * (s - avg(s) OVER (PARTITION BY b)) / greatest(stddev_pop(s) OVER (PARTITION BY b), 1e-12)"))


def _group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "embeddings")
    ranked = vectors.narrowed(vectors.top(vectors.scored_dense(df, "embedding", _probe(df), "cosine"), 12, "vec_id"))
    out = fusion.grouped(ranked, "label", 4, 3, "vec_id")
    return out.select("vec_id", F.col("_key").alias("key"), F.col("_group").cast("long").alias("place"), F.col("_rank").cast("long").alias("rank"))


_add("group_by_topk", _group_by, f"""
WITH t AS (SELECT vec_id, CAST(label AS VARCHAR) AS key, {_SQL_SCORE["cosine"]} AS s FROM {_EMB} ORDER BY s DESC, vec_id LIMIT 12),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s::FLOAT DESC, vec_id) AS rank FROM t),
g AS (SELECT *, max(s::FLOAT) OVER (PARTITION BY key) AS best FROM r WHERE rank <= 3),
p AS (SELECT *, dense_rank() OVER (ORDER BY best DESC, key) AS place FROM g)
SELECT vec_id, key, place, rank FROM p WHERE place <= 4
""")

"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import line_dedup, mixing, ngram_join, pii, secrets, sentencepiece_codec, spans, topk_search, toxicity, unit_dedup
from cairn.llm.common import table
from cairn.llm.exact_dedup import exact_dedup


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = unit_dedup.dedup_units(table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return done.select("doc_id", F.size("removed").alias("n_removed"), places.alias("removed"), F.coalesce("text", F.lit("")).alias("text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


def _span_columns(found: DataFrame, kinds: list[str]) -> DataFrame:
    base = spans.span_text(spans.base_spans(F.col("spans")))
    return found.select(
        "doc_id",
        *(spans.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(base, 256).alias("base_sha256"),
        spans.span_text(F.col("spans")).alias("spans"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS[:4])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_unit_dedup": op2_unit_dedup,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_secrets": op7_secrets,
    "op8_topk_search": op8_topk_search,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
}

def _scattered(x: str, key: str) -> str:
    """DuckDB's form of ``mixing.scattered``."""
    p = mixing._P
    a = f"(({x}) % {p} + 1) * {mixing._A} % {p}"
    b = f"xor({a}, (({x}) // {p} + ({key}) * 7919 + 1) % {p} * {mixing._C} % {p})"
    return f"(SELECT xor(c, c >> 11) FROM (SELECT xor(b, b >> 13) % {p} * {mixing._B} % {p} AS c FROM (SELECT CAST({b} AS BIGINT) AS b)))"


def _mixing_sql() -> str:
    """The same mix by one global order of blocks and rows."""
    rounds, last = [], "p0"
    for i, odd in enumerate(mixing._ODD):
        rounds.append(f"""a{i} AS (SELECT * REPLACE (CASE WHEN block < power THEN block * {odd} % power ELSE block END AS block) FROM {last}),
b{i} AS (SELECT * REPLACE (CASE WHEN block < power THEN xor(block, block >> (bits // 2 + 1)) ELSE block END AS block) FROM a{i}),
p{i + 1} AS (SELECT * REPLACE ((block + {_scattered("key", str(i))}) % blocks AS block) FROM b{i})""")
        last = f"p{i + 1}"
    size = mixing.BLOCK_WORDS
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM t),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 2 AS most FROM r),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5 - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, rank, source_size, least(most, max(level) OVER () * w) AS target, CAST(ceil(source_size / {size}) AS BIGINT) AS blocks FROM l),
s AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5), blocks * 2) ELSE 0 END AS BIGINT) AS slots FROM g),
p0 AS (SELECT rank, blocks, CAST(j % blocks AS BIGINT) AS block, rank * 2 + j // blocks AS key, length(bin(blocks)) - 1 AS bits, CAST(1 AS BIGINT) << (length(bin(blocks)) - 1) AS power
  FROM (SELECT *, unnest(range(slots)) AS j FROM s)),
{", ".join(rounds)},
k AS (SELECT rank, block, count(*) AS times FROM {last} GROUP BY ALL),
o AS (SELECT d.*, s.rank, s.source_size, s.target, CAST(coalesce(sum(size) OVER (PARTITION BY s.rank ORDER BY doc_id % {mixing.CHUNKS}, doc_id, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, unnest(range(start // {size}, (start + size - 1) // {size} + 1)) AS block FROM o WHERE size > 0),
x AS (SELECT b.row, CAST(sum((least(start + size, (b.block + 1) * {size}) - greatest(start, b.block * {size})) * k.times) AS BIGINT) AS taken FROM b JOIN k ON b.rank = k.rank AND b.block = k.block GROUP BY b.row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM o LEFT JOIN x ON o.row = x.row
"""


def _units_sql() -> str:
    """Tiles, their places and digests' stand-ins (the normalised text), runs of later ones, and the rest."""
    pattern, space = unit_dedup.TILES["clause"], r"[\x20\x09-\x0D]"
    return rf"""
WITH u AS (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS l FROM documents)),
p AS (SELECT *, CAST(coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
  coalesce(count(*) FILTER (u LIKE '%' || chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
  [x FOR x IN regexp_split_to_array(lower(u), '{space}+') IF x <> ''] AS w FROM u WHERE u <> ''),
k AS (SELECT *, CASE WHEN len(list_distinct(w)) >= {unit_dedup.UNIT_WORDS} THEN nullif(trim(array_to_string(w, ' '), '.,;:!?-*#|"''() '), '') END AS key FROM p),
g AS (SELECT *, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, n) > 1 AND (len(w) >= {unit_dedup.MIN_WORDS} OR min(doc_id) OVER (PARTITION BY key) <> doc_id) AS later, count(key) OVER (PARTITION BY doc_id ORDER BY n) AS unit FROM k),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id, later ORDER BY n) AS run FROM g),
s AS (SELECT *, later AND sum(len(w)) OVER (PARTITION BY doc_id, later, run) >= {unit_dedup.MIN_WORDS} AS gone FROM r),
t AS (SELECT *, bool_and(gone) OVER (PARTITION BY doc_id, line) AS all_gone FROM s)
SELECT d.doc_id, CAST(count(t.n) FILTER (gone) AS INTEGER) AS n_removed,
  coalesce(string_agg((a + length(regexp_extract(u, '^{space}*'))) || ':' || (a + length(regexp_replace(u, '{space}+$', ''))), ',' ORDER BY n) FILTER (gone), '') AS removed,
  coalesce(string_agg(CASE WHEN NOT gone THEN u WHEN u LIKE '%' || chr(10) AND NOT all_gone THEN chr(10) ELSE '' END, '' ORDER BY n), '') AS text
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
"""


ORACLE_SQL = {
    "op1_mixing": _mixing_sql(),
    "op2_unit_dedup": _units_sql(),
    "op8_topk_search": """
WITH s AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM s q JOIN s c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""",
}

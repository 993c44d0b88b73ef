"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dealt_back, salt_of, saved

SALTS = 64


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: links to the smallest neighbour, kept as u > v. The links of
    a hub are dealt to salts, so they never meet in one task."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    both = both.withColumn("salt", salt_of(F.col("v"), SALTS))
    least = dealt_back(both, ["u"], {"m": F.min("v")}, {"m": F.least(F.col("u"), F.min("m"))})
    linked = both.join(least, ["u", "salt"])
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that ``edges`` (u, v) link to another.

    Links stay distributed; each round is written to the shared folder, and rounds end when the
    links are stars, which is when a round changes neither their number nor their checksum.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = saved(now, "links"), None
    while True:
        now = saved(_step(_step(now, large=True), large=False), "links")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

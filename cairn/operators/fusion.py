"""Fusion of ranked routes and grouped top-k.

Branches are bounded by their limits before they meet, so fusion shuffles at most branches x limit rows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import invalid
from cairn.functions.scoring import public_score
from cairn.schema import PK

NORMALIZERS = ("none", "minmax", "zscore")
_LEAST = 1e-12


def normalized(method: str) -> Column:
    """A branch's scores brought to a common scale, within the branch."""
    if method not in NORMALIZERS:
        raise invalid(f"unknown normalisation {method!r}")
    w = Window.partitionBy("_branch")
    s = F.col("_score").cast("double")
    if method == "minmax":
        low, high = F.min(s).over(w), F.max(s).over(w)
        return (s - low) / F.greatest(high - low, F.lit(_LEAST))
    if method == "zscore":
        return (s - F.avg(s).over(w)) / F.greatest(F.stddev_pop(s).over(w), F.lit(_LEAST))
    return s


def fused(branches: list[DataFrame], pk: str = PK, method: str = "rrf", rank_constant: float = 60.0, weights: list[float] | None = None, normalize: str = "none") -> DataFrame:
    """pk and ``_score`` (float) of the fusion. Branches are (pk, _score), already limited, scores narrowed."""
    weights = list(weights or []) + [1.0] * (len(branches) - len(weights or []))
    marked = [b.select(F.lit(i).alias("_branch"), F.col(pk), F.col("_score").cast("float").cast("double").alias("_score"), F.lit(float(w)).alias("_w")) for i, (b, w) in enumerate(zip(branches, weights, strict=True))]
    rows = reduce(DataFrame.unionByName, marked)
    if method == "rrf":
        rank = F.row_number().over(Window.partitionBy("_branch").orderBy(F.col("_score").desc(), F.col(pk)))
        part = F.lit(1.0) / (F.lit(float(rank_constant)) + rank)
    elif method == "weighted":
        part = normalized(normalize) * F.col("_w")
    else:
        raise invalid(f"unknown fusion {method!r}")
    return rows.withColumn("_part", part).groupBy(pk).agg(F.sum("_part").alias("_sum")).select(pk, public_score(F.col("_sum")).alias("_score"))


def key_text(col: Column, kind: T.DataType) -> Column:
    """A group key as JSON text; a missing value as __null__."""
    if isinstance(kind, T.StringType):
        text = F.pandas_udf(_json_strings, "string")(col)
    elif isinstance(kind, (T.ArrayType, T.BooleanType, T.IntegralType)):
        text = F.to_json(col) if isinstance(kind, T.ArrayType) else col.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.pandas_udf(_json_floats, "string")(col.cast("double"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit("__null__"))


def _json_strings(values):
    return values.map(lambda v: None if v is None else json.dumps(v, ensure_ascii=False))


def _json_floats(values):
    return values.map(lambda v: None if v != v else repr(float(v)))


def grouped(ranked: DataFrame, key: str | None, group_count: int, group_topk: int, pk: str = PK) -> DataFrame:
    """``ranked`` (the best group_count * group_topk rows overall) cut to the first group_topk per key
    and the best group_count keys; with ``_key`` and ``_rank``, its place within the group."""
    text = key_text(F.col(key), ranked.schema[key].dataType) if key in ranked.columns else F.lit("__null__")
    best = (F.col("_score").desc(), F.col(pk).asc())
    rows = ranked.withColumn("_key", text).withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*best))).where(F.col("_rank") <= group_topk)
    rows = rows.withColumn("_best", F.max("_score").over(Window.partitionBy("_key")))
    # The rows are few by contract: group_count * group_topk.
    order = F.dense_rank().over(Window.orderBy(F.col("_best").desc(), F.col("_key").asc()))
    return rows.withColumn("_group", order).where(F.col("_group") <= group_count).drop("_best")

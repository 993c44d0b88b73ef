"""Exact vector search: score, radius, top-k by score and then key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.errors import CairnError, invalid
from cairn.functions import scoring
from cairn.schema import PK


def checked(score: Column) -> Column:
    """A score, or an error where it is not finite."""
    return F.when(F.abs(score) < float("inf"), score).otherwise(F.raise_error(F.lit("score is not finite")).cast("double"))


def scored_dense(df: DataFrame, field: str, query: Sequence[float], metric: str) -> DataFrame:
    """Rows whose vector has the query's length, with ``_score``."""
    fit = df.where(F.size(field) == len(query))
    return fit.withColumn("_score", checked(scoring.dense_score(F.col(field), query, metric)))


def scored_sparse(df: DataFrame, field: str, query: dict[int, float], metric: str) -> DataFrame:
    """Rows that have the sparse vector, with ``_score``."""
    return df.where(F.col(field).isNotNull()).withColumn("_score", checked(scoring.sparse_score(F.col(field), query, metric)))


def scored_binary(df: DataFrame, field: str, query: bytes, metric: str = "l2") -> DataFrame:
    """Rows whose packed vector has the query's length, with ``_score``."""
    return df.where(F.length(field) == len(query)).withColumn("_score", scoring.hamming_score(F.col(field), query, metric))


def top(df: DataFrame, k: int, pk: str = PK, floor: float | None = None) -> DataFrame:
    """The k best rows: score descending, key ascending; before that those under the radius floor go."""
    if k <= 0:
        raise invalid("topk must be positive")
    if floor is not None:
        df = df.where(F.col("_score") >= floor)
    return df.orderBy(F.col("_score").desc(), F.col(pk).asc()).limit(k)


def stored_vector(df: DataFrame, field: str, key, pk: str = PK):
    """The vector of one row, for queries by id."""
    row = df.where(F.col(pk) == key).select(field).first()
    if row is None:
        raise CairnError("not_found", f"no document {key!r}")
    if row[0] is None:
        raise CairnError("failed_precondition", f"document {key!r} has no {field}")
    return row[0]


def narrowed(df: DataFrame) -> DataFrame:
    """``_score`` as the public float."""
    return df.withColumn("_score", scoring.public_score(F.col("_score")))

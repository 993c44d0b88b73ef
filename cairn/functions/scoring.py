"""Exact scores as Columns, all doubles, higher is better."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.errors import invalid, unsupported


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dense_score(vector: Column, query: Sequence[float] | Column, metric: str) -> Column:
    """L2 (negative squared distance), inner product, cosine (0 for a zero norm) or MIPS (inner product)."""
    xs = vector.cast("array<double>")
    qs = query.cast("array<double>") if isinstance(query, Column) else F.array(*(F.lit(float(q)) for q in query))
    dot = lambda a, b: _total(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "l2":
        return -_total(F.zip_with(xs, qs, lambda x, y: (y - x) * (y - x)))
    if metric in ("ip", "mips_l2"):
        return dot(qs, xs)
    if metric != "cosine":
        raise invalid(f"unknown metric {metric!r}")
    norms = F.sqrt(dot(xs, xs)) * F.sqrt(dot(qs, qs))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(qs, xs) / norms)


def sparse_score(vector: Column, query: dict[int, float], metric: str) -> Column:
    """The same over the union of a sparse vector's and the query's indices."""
    mine = F.map_from_arrays(vector["indices"].cast("array<bigint>"), vector["values"].cast("array<double>"))
    items = sorted(query.items())
    dot = _total(F.array(*(F.coalesce(F.try_element_at(mine, F.lit(int(i)).cast("bigint")), F.lit(0.0)) * F.lit(float(q)) for i, q in items)))
    square = _total(F.transform(vector["values"].cast("array<double>"), lambda x: x * x))
    own = sum(float(q) * float(q) for _, q in items)
    if metric in ("ip", "mips_l2"):
        return dot
    if metric == "l2":
        theirs = F.map_keys(mine)
        outside = _total(F.transform(F.map_values(F.map_filter(mine, lambda k, v: ~k.isin([int(i) for i in query]))), lambda x: x * x))
        inside = _total(F.array(*((F.coalesce(F.try_element_at(mine, F.lit(int(i)).cast("bigint")), F.lit(0.0)) - float(q)) ** 2 for i, q in items)))
        return F.when(theirs.isNotNull(), -(outside + inside))
    if metric != "cosine":
        raise invalid(f"unknown metric {metric!r}")
    return F.when((square == 0) | F.lit(own == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(square) * F.lit(own**0.5)))


def words_of(bits: Column, dimension: int) -> Column:
    """A packed binary vector as 32-bit words in longs."""
    word = lambda i: F.conv(F.hex(F.substring(bits, 4 * i + 1, 4)), 16, 10).cast("long")
    return F.array(*(word(i) for i in range(dimension // 32)))


def hamming_score(bits: Column, query: bytes, metric: str = "l2") -> Column:
    """Minus the number of bits that differ; L2 only."""
    if metric != "l2":
        raise unsupported("binary vectors have the L2 metric only")
    if len(query) % 4:
        raise invalid("a binary query must be whole 32-bit words")
    words = [int.from_bytes(query[i : i + 4], "big") for i in range(0, len(query), 4)]
    mine = words_of(bits, 8 * len(query))
    return -sum((F.bit_count(mine[i].bitwiseXOR(F.lit(w).cast("long"))) for i, w in enumerate(words)), F.lit(0)).cast("double")


def radius_floor(metric: str, radius: float) -> float:
    """The least score within a radius: -r*r for L2, r itself for the others."""
    if metric == "l2":
        if radius < 0:
            raise invalid("an L2 radius cannot be negative")
        return -radius * radius
    return radius


def public_score(score: Column) -> Column:
    """A score as float; one that is not finite as float is an error."""
    bound = F.lit(3.4028235677973366e38)
    return F.when(F.abs(score) < bound, score.cast("float")).otherwise(F.raise_error(F.lit("score is not finite")).cast("float"))

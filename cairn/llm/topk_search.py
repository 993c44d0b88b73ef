"""Exact top-k inner-product search over a bit-sliced index.

Method. Vectors become integers, and each dimension of a block of rows becomes bit slices: one
bitmap over the block's rows per binary digit. The slices are built once and stored, a row for each
block; they take a byte or so a component. A query adds the slices of all dimensions, weighted
by the digits of its own components, with carry-save adders on whole bitmaps; a negative component
uses the complemented slices, which shifts every score by the same constant. The top rows are then
selected from the most significant slice of the sum downward: rows certain to be in, and rows still
level. Level rows left at the end have exactly equal scores, and the smallest ids are taken.

Stored blocks and blocks of queries meet by the pair of their numbers, so no task holds more than one
of each and no row meets a row outside its blocks. A query block has up to ``QUERY_BLOCK`` queries (fewer
only while there are fewer pairs than partitions), so that the copies of stored blocks stay far
below the work of the search. Rows with a component beyond ``NARROW`` are kept beside the slices and
multiplied with integers of any size.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import partitions, saved

#: Rows and queries of one block.
ROW_BLOCK = 32_768
QUERY_BLOCK = 16_384
#: Largest component of a row in the slices: products of two such rows of 32,768 dimensions fit 63 bits.
NARROW = 1 << 24

_HIT = "query_id long, vec_id long, score long, beyond binary"
_INDEX = "rb long, d int, ids binary, low binary, digits int, slices binary, wide_ids binary, wide array<array<string>>"
_LONG = (1 << 63) - 1
#: Bytes of a score beyond 64 bits, as an ordered binary number: two doubles' product over any dimension.
_WIDE_BYTES = 280


def sound(vector: Column) -> Column:
    """The components as doubles, or null for vectors that take no part."""
    xs = vector.cast("array<double>")
    # NaN is greater than any number here, so one comparison excludes it together with infinity.
    return F.when(F.forall(xs, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), xs)


def quantised(column: pa.Array, d: int, scale: float) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """floor(scale * x) of each component: which rows are narrow, their matrix, and the other rows."""
    xs = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    with np.errstate(over="ignore"):
        scaled = np.floor(xs * scale)
    narrow = (np.abs(scaled) <= NARROW).all(1)
    exact = Fraction(scale)
    return narrow, scaled[narrow].astype(np.int64), [[floor(Fraction(float(x)) * exact) for x in row] for row in xs[~narrow]]


def added(stacks: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bit slices of the sum of all bitmaps, each worth 2**exponent; stacks hold 2-D groups of them."""
    out, e = [], min(stacks, default=0)
    while stacks:
        rows = np.concatenate(stacks.pop(e)) if e in stacks else None
        while rows is not None and len(rows) > 1:
            k = max(1, len(rows) // 3)
            a, b = rows[:k], rows[k : 2 * k]
            c = rows[2 * k : 3 * k] if len(rows) > 2 else np.zeros_like(a)
            half = a ^ b
            stacks.setdefault(e + 1, []).append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * k :]]) if len(rows) > 3 * k else half ^ c
        out.append((e, rows[0] if rows is not None else None))
        e += 1
    return out


class SlicedBlock:
    """The bit slices of one block of rows, in id order: digit, dimension, word."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.low, self.slices, self.digits = ids, low, slices, len(slices)
        full = np.zeros(-(-len(ids) // 64) * 64, np.uint8)
        full[: len(ids)] = 1
        self.rows = np.packbits(full, bitorder="little").view("<u8")

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        vectors, n = vectors[order], len(ids)
        low = vectors.min(0) if n else np.zeros(vectors.shape[1], np.int64)
        shifted = (vectors - low).astype(np.uint64).T  # dimensions x rows
        digits, words = max(1, int(shifted.max(initial=0)).bit_length()), -(-n // 64)
        bits = np.zeros((digits, len(low), words * 64), np.uint8)
        for b in range(digits):
            bits[b, :, :n] = (shifted >> np.uint64(b)) & np.uint64(1)
        packed = np.packbits(bits, axis=-1, bitorder="little")
        return cls(ids[order], low, packed.view("<u8") if packed.size else np.zeros((digits, len(low), words), "<u8"))

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """The rows at these places, from their slices."""
        bits = (self.slices[:, :, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return (self.low[:, None] + (bits.astype(np.int64) << np.arange(self.digits)[:, None, None]).sum(0)).T

    def _sum(self, query: np.ndarray) -> list[tuple[int, np.ndarray | None]]:
        stacks: dict[int, list[np.ndarray]] = defaultdict(list)
        size, negative = np.abs(query), query < 0
        for i in range(int(size.max(initial=0)).bit_length()):
            on = (size >> i) & 1 == 1
            plus, minus = on & ~negative, on & negative
            for b in range(self.digits):
                if plus.any():
                    stacks[i + b].append(self.slices[b, plus])
                if minus.any():
                    stacks[i + b].append(~self.slices[b, minus])
        return added(dict(stacks))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows other than the query's own, in no order."""
        level = self.rows.copy()
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            level[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        sure = np.zeros_like(level)
        count = lambda m: int(np.bitwise_count(m).sum())
        for _, digit in reversed(self._sum(query)):
            if digit is None:
                digit = np.zeros_like(level)
            tried = sure | (level & digit)
            if (n := count(tried)) > k:
                level = level & digit
            else:
                sure, level = tried, level & ~digit
                if n == k:
                    break
        unpack = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        first = unpack(sure)
        at = np.concatenate([first, unpack(level)[: k - len(first)]])
        return self.ids[at], self.vectors(at) @ query


def _indexer(scale: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rb, d = (k.as_py() for k in key)
        rows = rows.combine_chunks()
        ids = rows.column("vec_id").to_numpy()
        narrow, matrix, wide = quantised(rows.column("v").chunk(0), d, scale)
        block = SlicedBlock.of(ids[narrow], matrix)
        row = [rb, d, block.ids.astype("<i8").tobytes(), block.low.astype("<i8").tobytes(), block.digits, block.slices.tobytes(), ids[~narrow].astype("<i8").tobytes(), [[str(x) for x in w] for w in wide]]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.string()))]
        return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[f.split()[0] for f in _INDEX.split(", ")])

    return run


def _ordered_bytes(score: int) -> bytes:
    return (score + (1 << (8 * _WIDE_BYTES - 1))).to_bytes(_WIDE_BYTES)


def _searcher(k: int, scale: float):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, bytes | None]] = []
        for row in index.to_pylist() if queries.num_rows else []:
            d, digits = row["d"], row["digits"]
            ids = np.frombuffer(row["ids"], "<i8")
            block = SlicedBlock(ids, np.frombuffer(row["low"], "<i8"), np.frombuffer(row["slices"], "<u8").reshape(digits, d, -(-len(ids) // 64)))
            beside = list(zip(np.frombuffer(row["wide_ids"], "<i8").tolist(), [[int(x) for x in w] for w in row["wide"]], strict=True))
            everything: list[tuple[int, list[int]]] = []
            table = queries.combine_chunks()
            narrow, matrix, wide = quantised(table.column("v").chunk(0), d, scale)
            narrow_at, wide_at = iter(matrix), iter(wide)
            for q, small in zip(table.column("vec_id").to_pylist(), narrow, strict=True):
                if small:
                    vector = next(narrow_at)
                    some, scores = block.top(q, vector, k)
                    best = [(int(s), int(i)) for i, s in zip(some, scores, strict=True)]
                    exact, rest = [int(x) for x in vector], beside
                else:
                    if not everything:
                        everything = [*zip(ids.tolist(), block.vectors(np.arange(len(ids))).tolist(), strict=True), *beside]
                    best, exact, rest = [], next(wide_at), everything
                best += [(sum(a * b for a, b in zip(exact, v, strict=True)), i) for i, v in rest if i != q]
                for s, i in sorted(best, key=lambda x: (-x[0], x[1]))[:k]:
                    held = max(-_LONG - 1, min(_LONG, s))
                    found.append((q, i, held, None if held == s else _ordered_bytes(s)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        cols = list(zip(*found, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest integer inner products over
    all rows but those with its own id, ties to the smaller id; all of them if fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id or vectors of another length than the query's; empty vectors score 0 with each other. Repeated
    rows stay repeated candidates, and a query id that repeats is asked once for each length (the row
    with the smallest vector) and ranked together. Ranks are exact whatever the size of the components; a score beyond 64
    bits is given as the nearest long. Other columns are ignored; empty input gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), sound(F.col("embedding")).alias("v"), is_query.alias("q")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).withColumn("d", F.size("v"))
    n_rows, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    row_blocks = max(1, -(-n_rows // row_block))
    query_blocks = max(1, -(-n_queries // query_block), min(-(-partitions(spark) // row_blocks), -(-n_queries // 64)))
    index = saved(rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks))).select("rb", "d", "vec_id", "v").groupBy("rb", "d").applyInArrow(_indexer(scale), _INDEX), "slices")
    asked = rows.where("q").groupBy("vec_id", "d").agg(F.min("v").alias("v"))
    queries = asked.select("vec_id", "v", "d", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<bigint>")).alias("rb"))
    blocks = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    key = ("qb", "rb", "d")
    hits = blocks.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_searcher(k, scale), _HIT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

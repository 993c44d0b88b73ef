"""Exact deduplication by Grace hashing.

Method. Records are dealt to spill files by the leading digits of a content digest (Spark's
shuffle files are those spill files: written once, sorted by digest, fetched by whoever runs the
bucket, and rebuilt from lineage if an executor is lost). A bucket whose distinct content exceeds
``bucket_bytes`` is split again by the next digest digit, and so on, until a part fits the
open-addressing table that compares complete content. Because a bucket's rows arrive in digest
order, one level of recursion is one more digit of the prefix a table has to hold.

Copies are folded before the shuffle: every map task runs the same table over its own rows and
sends one record per content, with its smallest id, its count, and the set of row salts it saw (a
64-bit mask). A group that holds a third of all rows therefore reaches its bucket once per map
task, and its members learn their keeper over up to 64 salted keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_RUN, partitions, salt_of, small_batches

#: Salts of a content's member rows: as many as a long has bits.
SALTS = 64
#: Content bytes that one open-addressing table may hold.
BUCKET_BYTES = 64 << 20

_FOLDED = "digest string, content binary, first_id long, copies long, salts long"
_DECIDED = "digest string, salt int, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """Text with every white-space run as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


class ContentTable:
    """Open addressing with linear probing over 64-bit digests; equality is decided on whole content."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self._slots = np.full(slots, -1, dtype=np.int64)
        self._marks: list[int] = []
        self.rows: list[list] = []  # [digest, content, first_id, copies, salts]
        self.bytes = 0

    def add(self, digest: str, content: bytes, first_id: int | None, copies: int, salts: int) -> None:
        mark, slots = int(digest[-15:], 16), self._slots
        at = mark & (len(slots) - 1)
        while (i := int(slots[at])) >= 0:
            row = self.rows[i]
            if self._marks[i] == mark and row[1] == content:
                if first_id is not None and (row[2] is None or first_id < row[2]):
                    row[2] = first_id
                row[3] += copies
                row[4] |= salts
                return
            at = (at + 1) & (len(slots) - 1)
        slots[at] = len(self.rows)
        self._marks.append(mark)
        self.rows.append([digest, content, first_id, copies, salts])
        self.bytes += len(content)
        if 2 * len(self.rows) > len(slots):
            self._grow()

    def _grow(self) -> None:
        self._slots = np.full(4 * len(self._slots), -1, dtype=np.int64)
        mask = len(self._slots) - 1
        for i, mark in enumerate(self._marks):
            at = mark & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = i


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _folded(table: ContentTable) -> pa.RecordBatch:
    d, c, i, n, s = zip(*table.rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(d), pa.array(c, pa.binary()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array([_signed(x) for x in s], pa.int64())],
        ["digest", "content", "first_id", "copies", "salts"],
    )


def _fold(limit: int):
    """Map side: one record per content of this task; the table is emptied when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            ids, digests, contents, salts = (batch.column(k) for k in ("_id", "_digest", "_content", "_salt"))
            for i, digest, content, salt in zip(ids.to_pylist(), digests.to_pylist(), contents.to_pylist(), salts.to_pylist(), strict=True):
                table.add(digest, content, i, 1, 1 << salt)
            if table.bytes > limit // 4:
                yield _folded(table)
                table = ContentTable()
        if table.rows:
            yield _folded(table)

    return run


def _decide(limit: int):
    """Bucket side: rows come in digest order. The open part is the set of digests that share the
    current prefix; when it outgrows ``limit`` the prefix gets one digit longer and the digests that
    fall outside it, which can get no more rows, are closed."""

    def close(table: ContentTable) -> pa.RecordBatch:
        out = [(d, k, i, n) for d, _, i, n, mask in table.rows for k in range(SALTS) if mask >> k & 1]
        d, k, i, n = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(k, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int64())], ["digest", "salt", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, depth = ContentTable(), 1
        prefix: str | None = None
        for batch in batches:
            for digest, content, i, n, mask in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if prefix is not None and digest[:depth] != prefix:
                    yield close(table)
                    table, prefix, depth = ContentTable(), None, 1
                while table.bytes > limit and depth < len(digest):
                    depth += 1
                    prefix = digest[:depth]
                    gone, kept = ContentTable(), ContentTable()
                    for row in table.rows:
                        (kept if row[0][:depth] == prefix else gone).add(*row)
                    if gone.rows:
                        yield close(gone)
                    table = kept
                prefix = digest[:depth]
                table.add(digest, content, i, n, mask & ((1 << 64) - 1))
        if table.rows:
            yield close(table)

    return run


def exact_groups(docs: DataFrame, content: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``content`` is the text to compare, never null. The row with the smallest doc_id of equal
    contents stays; of repeated rows with that id, one stays. A null id comes after all others, so
    it stays only in a group that has no other (keep_id is then null). Empty content is content
    like any other; an empty table gives no rows; other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), content.alias("_text")).select(
        "_id", F.sha2(F.col("_text"), 256).alias("_digest"), F.encode("_text", "utf-8").alias("_content"), salt_of(F.col("_id"), SALTS).alias("_salt")
    )
    folded = keyed.mapInArrow(_fold(bucket_bytes), _FOLDED)
    buckets = folded.repartition(partitions(spark), F.xxhash64("digest")).sortWithinPartitions("digest")
    decided = buckets.mapInArrow(_decide(bucket_bytes), _DECIDED).alias("d")
    members = keyed.select("_id", "_digest", "_salt").alias("m")
    joined = members.join(decided, (F.col("m._digest") == F.col("d.digest")) & (F.col("m._salt") == F.col("d.salt")))
    turn = F.row_number().over(Window.partitionBy("_digest", "_salt", "_id").orderBy(F.lit(1)))
    return joined.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (turn == 1)).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``exact_groups`` over white-space-normalised ``text`` (null: empty)."""
    return exact_groups(docs, normalised(F.col("text")), bucket_bytes)

"""Shared pieces of the text operators: table access, scratch tables and batch sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space in the operators' contracts, and its complement (a word).
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows per Arrow batch. Documents can hold megabytes, so a batch stays small in rows.
ARROW_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark so that any supported store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows per Arrow batch for the Python stages that follow in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, giving freed memory back to the system when a task ends: Spark keeps the
    worker for later tasks, and what it holds meanwhile counts against the executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return wrapped


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset a session in one process gets a
    fresh local one; on a cluster other machines could not read that, so the call fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_OPEN: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``saved`` writes inside when it ends. What reads them must have been written
    out by then; outside of it they stay, as the results of lazy queries read them."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Hadoop's readers know."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks it ran; a later stage rereads the files.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cairn/{tag}-{uuid.uuid4().hex}"
    for tables in _OPEN[-1:]:
        tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sets in proportion to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(key: Column, ways: int) -> Column:
    """A salt that depends on the row alone, so a recomputed task deals it out alike."""
    return F.pmod(F.xxhash64(key), F.lit(ways)).cast("int")


def dealt_back(rows: DataFrame, keys: list[str], first: dict[str, Column], then: dict[str, Column]) -> DataFrame:
    """Aggregates of ``rows`` by ``keys``, gathered over their column salt (``first`` within a salt,
    ``then`` over salts), with a row for each salt in use: joined by keys and salt, no key meets in one task."""
    by_salt = rows.groupBy(*keys, "salt").agg(*(c.alias(k) for k, c in first.items()))
    return by_salt.groupBy(*keys).agg(*(c.alias(k) for k, c in then.items()), F.collect_set("salt").alias("salts")).withColumn("salt", F.explode("salts")).drop("salts")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as one struct, _row: no column of theirs can clash with one of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of the packed rows, some of them replaced."""
    return [replaced.get(c, F.col("_row").getField(c)).alias(c) for c in columns]

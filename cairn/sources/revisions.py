"""Versioned document tables: Parquet directories and one manifest, swapped atomically.

A revision is a list of parts, each with rows and the keys that it deletes from the parts before. A
commit writes the new directory first and then renames the manifest: readers see the old revision or
the new one. Paths go through Hadoop's FileSystem, so any store that Spark writes works; ``rename`` of
the manifest must be atomic there.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError
from cairn.schema import PK, CollectionSchema


@dataclass(frozen=True)
class Manifest:
    """What a revision consists of."""

    revision: int
    schema: CollectionSchema
    #: (rows, keys deleted from the parts before), either of them None.
    parts: tuple[tuple[str | None, str | None], ...] = ()
    count: int = 0

    def to_json(self) -> str:
        body = {"revision": self.revision, "schema": self.schema.to_json(), "parts": [list(p) for p in self.parts], "count": self.count}
        return json.dumps(body | {"crc": zlib.crc32(json.dumps(body, sort_keys=True).encode())})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            body = json.loads(text)
            crc = body.pop("crc")
        except (ValueError, KeyError) as e:
            raise CairnError("corruption", "manifest cannot be read") from e
        if crc != zlib.crc32(json.dumps(body, sort_keys=True).encode()):
            raise CairnError("corruption", "manifest checksum differs")
        return cls(body["revision"], CollectionSchema.from_json(body["schema"]), tuple((a, b) for a, b in body["parts"]), body["count"])


class Store:
    """Files of one collection."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}" if name else self.root))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str, overwrite: bool = False) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}" if name else self.root), True)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self.exists() else []

    # The writer's lock: a file that only one writer can create.
    def lock(self) -> None:
        try:
            self.write_text("_writer", uuid.uuid4().hex)
        except Exception as e:
            raise CairnError("already_exists", f"{self.root} has a writer") from e

    def unlock(self) -> None:
        self.delete("_writer")

    def manifest(self) -> Manifest:
        found = sorted((n for n in self.names() if n.startswith("manifest-") and n.endswith(".json")), reverse=True)
        if not found:
            raise CairnError("not_found", f"no collection in {self.root}")
        return Manifest.from_json(self.read_text(found[0]))

    def commit(self, manifest: Manifest) -> None:
        """Make a revision current. The rename is the commit point."""
        temp, final = f"_temp-{uuid.uuid4().hex}", f"manifest-{manifest.revision:012d}.json"
        self.write_text(temp, manifest.to_json())
        if not self._fs.rename(self._path(f"{self.root}/{temp}"), self._path(f"{self.root}/{final}")):
            self.delete(temp)
            raise CairnError("unavailable", "another writer committed first")

    def write(self, df: DataFrame, kind: str = "data") -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def table(self, manifest: Manifest) -> DataFrame:
        """The documents of a revision: rows of each part without the keys that a later part deletes."""
        schema = manifest.schema.spark
        read = lambda name, s: self.spark.read.schema(s).parquet(f"{self.root}/{name}")
        data = [read(d, schema).withColumn("_seq", F.lit(i)) for i, (d, _) in enumerate(manifest.parts) if d]
        gone = [read(k, f"{PK} string").withColumn("_gone", F.lit(i)) for i, (_, k) in enumerate(manifest.parts) if k]
        if not data:
            return self.spark.createDataFrame([], schema)
        docs = reduce(DataFrame.unionByName, data)
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy(PK).agg(F.max("_gone").alias("_gone"))
            docs = docs.join(last, PK, "left").where(F.col("_gone").isNull() | (F.col("_seq") >= F.col("_gone")))
        return docs.select(*schema.names)

    def changes(self, manifest: Manifest, covered: int) -> tuple[DataFrame, DataFrame]:
        """What the parts from number ``covered`` on change: the documents that they add and that are still
        there, and the keys of earlier documents that they delete or replace."""
        schema = manifest.schema.spark
        keys = [self.spark.read.schema(f"{PK} string").parquet(f"{self.root}/{k}") for _, k in manifest.parts[covered:] if k]
        gone = reduce(DataFrame.unionByName, keys).distinct() if keys else self.spark.createDataFrame([], f"{PK} string")
        # Earlier parts without rows: their keys can delete nothing here.
        later = replace(manifest, parts=tuple((None, None) for _ in range(covered)) + tuple(manifest.parts[covered:]))
        return self.table(later).select(*schema.names), gone

    def size(self, name: str) -> int:
        """Bytes of a file or directory."""
        return self._fs.getContentSummary(self._path(f"{self.root}/{name}")).getLength()

    def age(self, name: str) -> float:
        """Seconds since a file or directory was written."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime() / 1000

    def prune(self, retain_seconds: float) -> None:
        """Remove manifests whose successor is older than ``retain_seconds``, and the directories of that age
        that the kept ones do not name. The current revision always stays."""
        manifests = sorted((n for n in self.names() if n.startswith("manifest-")), reverse=True)
        current = manifests[:1] + [n for n, successor in zip(manifests[1:], manifests, strict=False) if self.age(successor) < retain_seconds]
        kept: set[str] = set(current) | {"_writer", "config.json"}
        for n in current:
            for pair in Manifest.from_json(self.read_text(n)).parts:
                kept |= {p for p in pair if p}
        for n in self.names():
            if n not in kept and not n.startswith("index-") and self.age(n) >= retain_seconds:
                self.delete(n)


def evolved(manifest: Manifest, **changes: Any) -> Manifest:
    return replace(manifest, revision=manifest.revision + 1, **changes)

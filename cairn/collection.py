"""A collection: a schema, revisions of its documents, queries, changes and derived indexes."""

from __future__ import annotations

import asyncio
import json
import threading
import time
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cairn import config
from cairn.config import NO_CEILINGS, Config
from cairn.errors import CairnError, invalid, unsupported
from cairn.functions.analysis import Analyzer
from cairn.functions.scoring import radius_floor
from cairn.operators import ann, fts, fusion
from cairn.operators import vector as vectors
from cairn.plans import documents, filters, query_string
from cairn.plans.queries import GroupByQuery, MultiQuery, SearchQuery, metric_of, validated
from cairn.plans.records import Record, plain
from cairn.schema import NULLS, PK, CollectionSchema, FieldSchema, IndexParams
from cairn.sources.revisions import Manifest, Store, evolved


#: Fixed value: so many (key, score) rows at most are sent to every task.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Limits:
    """Ceilings; None is unlimited."""

    documents: int | None = None
    batch: int | None = None
    candidates: int | None = None
    #: Bytes of the current revision's parts and of derived tables.
    bytes: int | None = None

    def __post_init__(self) -> None:
        if any(x is not None and x <= 0 for x in (self.documents, self.batch, self.candidates, self.bytes)):
            raise invalid("limits must be positive")


@dataclass(frozen=True)
class Options:
    read_only: bool = False
    limits: Limits = field(default_factory=Limits)
    #: What differs from the process's defaults (``cairn.config``); None takes those.
    config: Config | None = None


@dataclass(frozen=True)
class WriteResult:
    id: str
    ok: bool
    code: str = ""
    message: str = ""


class Collection:
    """A handle to a collection directory. One writer at a time; readers pin the revision they opened."""

    def __init__(self, store: Store, manifest: Manifest, options: Options) -> None:
        self._store, self._manifest, self._options = store, manifest, options
        self._open, self._mutex, self._counts = True, threading.RLock(), Counter()
        self._config = options.config or config.current()

    # Lifecycle.

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: CollectionSchema, options: Options | None = None) -> Collection:
        """Create an empty collection and open it."""
        store = Store(spark, path)
        if any(n.startswith("manifest-") for n in store.names()):
            raise CairnError("already_exists", f"{path} holds a collection")
        for f in schema.fields:
            if f.index and f.index.kind == "fts":
                _analyzer(f)
        store.lock()
        manifest = Manifest(1, schema)
        store.commit(manifest)
        return cls(store, manifest, options or Options())

    create_and_open = create

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Collection:
        """Open the current revision; a repeated key is corruption."""
        store, options = Store(spark, path), options or Options()
        manifest = store.manifest()
        if not options.read_only:
            store.lock()
        out = cls(store, manifest, options)
        try:
            out._admit_stored()
        except CairnError:
            out.close()
            raise
        if out.documents().groupBy(PK).count().where("count > 1").limit(1).count():
            out.close()
            raise CairnError("corruption", "a key repeats")
        return out

    @property
    def path(self) -> str:
        return self._store.root

    @property
    def is_open(self) -> bool:
        return self._open

    @property
    def schema(self) -> CollectionSchema:
        return self._manifest.schema

    @property
    def revision(self) -> int:
        return self._manifest.revision

    def close(self) -> None:
        if self._open and not self._options.read_only:
            self._store.unlock()
        self._open = False

    def destroy(self) -> None:
        self._writable()
        self._open = False
        self._store.delete("")

    def flush(self) -> None:
        """Checkpoint: one Parquet directory for the revision. Revisions that readers may have open stay until
        ``vacuum``; nothing to do if the revision is one directory."""
        self._writable()
        if len(self._manifest.parts) > 1:
            name = self._store.write(self._clustered(self.documents()))
            try:
                self._config.ceilings.admit("snapshot_bytes", self._store.size(name))
            except CairnError:
                self._store.delete(name)
                raise
            self._commit(evolved(self._manifest, parts=((name, None),)))

    def _clustered(self, df: DataFrame) -> DataFrame:
        """Rows by the first scalar with an inverted index, so that filters on it skip files and row groups. The
        key splits a value that many rows share."""
        first = next((f.name for f in self.schema.fields if f.index and f.index.kind == "invert" and not f.type.startswith("array_")), None)
        return df if first is None else df.repartitionByRange(first, PK).sortWithinPartitions(first, PK)

    def vacuum(self, retain_seconds: float = 7 * 86_400) -> None:
        """Delete what only revisions older than ``retain_seconds`` name. A reader, or a DataFrame not yet
        run, that is older than that loses its files, as with any store of immutable parts."""
        self._writable()
        self._store.prune(retain_seconds)

    def _check(self) -> None:
        if not self._open:
            raise CairnError("failed_precondition", "the collection is closed")

    def _writable(self) -> None:
        self._check()
        if self._options.read_only:
            raise CairnError("permission_denied", "the collection is open for reading only")

    def _bytes(self, parts: Iterable[tuple[str | None, str | None]]) -> int:
        return sum(self._store.size(n) for part in parts for n in part if n)

    def _admit_stored(self) -> None:
        """An error if what is to be opened is above a ceiling: the first part is the last checkpoint."""
        ceilings, parts = self._config.ceilings, self._manifest.parts
        if ceilings != NO_CEILINGS:
            ceilings.admit("snapshot_bytes", self._bytes(parts[:1]))
            ceilings.admit("wal_replay_bytes", self._bytes(parts[1:]))

    def _admit(self, manifest: Manifest) -> None:
        """An error, and none of the new parts left, if a revision would grow beyond a limit."""
        limits, old = self._options.limits, self._manifest
        new = [p for p in manifest.parts if p not in old.parts]
        over = limits.documents is not None and manifest.count > max(limits.documents, old.count)
        if not over and limits.bytes is not None and any(d for d, _ in new):
            indexes = sum(self._store.size(n) for n in self._store.names() if n.startswith("index-"))
            over = self._bytes(manifest.parts) + indexes > limits.bytes
        if over:
            for name in (n for part in new for n in part if n):
                self._store.delete(name)
            raise CairnError("resource_exhausted", f"the collection is limited to {limits}")

    def _commit(self, manifest: Manifest) -> None:
        self._admit(manifest)
        self._store.commit(manifest)
        self._manifest = manifest

    def _changed(self, manifest: Manifest) -> None:
        """Commit a change of documents, and checkpoint if the configuration asks for it by now."""
        self._commit(manifest)
        self._counts["commits"] += 1
        parts, c = self._manifest.parts[1:], self._config
        if parts and (c.checkpoint_parts and len(parts) >= c.checkpoint_parts or c.checkpoint_bytes and self._bytes(parts) >= c.checkpoint_bytes):
            self.flush()

    # Reading.

    def documents(self) -> DataFrame:
        """The documents of the current revision, unordered."""
        self._check()
        return self._store.table(self._manifest)

    def count(self) -> int:
        return self.documents().count()

    def _public(self, df: DataFrame, fields: Iterable[str] | None, include_vector: bool) -> DataFrame:
        """The columns a result shows: all scalars, or those named; vectors only if asked for."""
        names = [f.name for f in self.schema.fields] if fields is None else [f.name for f in self.schema.fields if f.name in set(fields)]
        shown = [v.name for v in self.schema.vectors if include_vector and (fields is None or v.name in set(fields))]
        extra = [c for c in ("_doc_id", "_score") if c in df.columns]
        return df.select(PK, *names, *shown, *extra)

    def fetch(self, pks: list[str], fields: Iterable[str] | None = None, include_vector: bool = True) -> DataFrame:
        """Documents by key, in the order asked for; missing ones are left out, repeated ones repeat."""
        spark = self._store.spark
        asked = spark.createDataFrame(list(enumerate(pks)), f"_at int, {PK} string")
        return self._public(F.broadcast(asked).join(self.documents(), PK).orderBy("_at"), fields, include_vector)

    def iter(self, fields: Iterable[str] | None = None, include_vector: bool = True) -> Iterator[Row]:
        """All documents of this revision in key order, a partition at a time."""
        return self._public(self.documents().orderBy(PK), fields, include_vector).toLocalIterator()

    def with_ordinals(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_doc_id``, the place of each key in the revision, by range-partitioned counting."""
        return df.join(ann.ordinals(self.documents().select(PK)), PK, "left")

    def _ranked(self, q: SearchQuery) -> DataFrame:
        """The best rows of a query, whole documents with ``_score`` (double)."""
        validated(q, self.schema)
        docs = self.documents()
        rows = filters.where(docs, q.filter)
        if (most := self._options.limits.candidates) is not None and rows.count() > most:
            raise CairnError("resource_exhausted", f"more than {most} candidates")
        self._counts["queries"] += 1
        if q.route in ("match_string", "query_string"):
            analyzer, operator = _analyzer(self.schema.field(q.field_name)), q.params.get("default_operator", "or").lower()
            make = query_string.match_terms if q.route == "match_string" else lambda t, a, o: query_string.parse(t, a, q.field_name, o)
            tree = make(q.match_string or q.query_string, analyzer, operator)
            best = vectors.top(fts.search(docs, rows, q.field_name, tree, analyzer, PK, self._text_index(q.field_name)), q.topk)
            # Whole documents are read for the best alone.
            return docs.join(F.broadcast(best) if q.topk <= BROADCAST_ROWS else best, PK)
        v = self.schema.vector(q.field_name)
        metric = metric_of(q, v)
        radius = q.radius if q.radius is not None else (q.params.get("radius") or None)
        floor = None if radius is None else radius_floor(metric, radius)
        probe: Any = q.vector or q.binary or (dict(q.sparse) if q.sparse else None)
        if q.route == "source_id":
            probe = vectors.stored_vector(docs, v.name, q.source_id)
            probe = bytes(probe) if v.binary else dict(zip(probe["indices"], probe["values"], strict=True)) if v.sparse else list(probe)
        if v.binary:
            return vectors.top(vectors.scored_binary(rows, v.name, probe), q.topk, floor=floor)
        if v.sparse:
            return vectors.top(vectors.scored_sparse(rows, v.name, probe, metric), q.topk, floor=floor)
        index = v.index
        if index and index.kind != "flat" and not q.params.get("is_linear") and index["metric"] == metric and (near := self._near(v.name, index, probe, q, rows.select(PK) if q.filter else None)) is not None:
            ranked = vectors.top(vectors.scored_dense(rows.join(near, PK, "left_semi"), v.name, probe, metric), q.topk, floor=floor)
            # Too few candidates: the exact scan decides.
            if near.count() >= q.topk:
                return ranked
            self._counts["fallbacks"] += 1
        return vectors.top(vectors.scored_dense(rows, v.name, probe, metric), q.topk, floor=floor)

    def query(self, q: SearchQuery) -> DataFrame:
        """The best documents of one route, with ``_score`` as float."""
        ranked = self._ranked(q)
        if q.include_doc_id:
            ranked = self.with_ordinals(ranked)
        best = ranked.orderBy(F.col("_score").desc(), PK)
        return self._public(vectors.narrowed(best), q.output_fields, q.include_vector)

    def multi_query(self, q: MultiQuery) -> DataFrame:
        """The fusion of several routes on this revision."""
        branches = [vectors.narrowed(self._ranked(replace(b, filter=b.filter or q.filter)).select(PK, "_score")) for b in q.branches]
        best = vectors.top(fusion.fused(branches, PK, q.method, q.rank_constant, list(q.weights), q.normalize), q.topk)
        whole = self.documents().join(F.broadcast(best), PK)
        return self._public(whole.orderBy(F.col("_score").desc(), PK), q.output_fields, q.include_vector)

    def group_by(self, q: GroupByQuery) -> DataFrame:
        """Grouped top-k: the best documents overall, then cut by key (see ``fusion.grouped``)."""
        wide = replace(q.query, topk=q.group_count * q.group_topk)
        return fusion.grouped(self.query(wide), q.group_by, q.group_count, q.group_topk).orderBy("_group", "_rank")

    group_by_query = group_by

    async def query_async(self, q: SearchQuery) -> list[Row]:
        return await asyncio.to_thread(lambda: self.query(q).collect())

    async def multi_query_async(self, q: MultiQuery) -> list[Row]:
        return await asyncio.to_thread(lambda: self.multi_query(q).collect())

    async def group_by_async(self, q: GroupByQuery) -> list[Row]:
        return await asyncio.to_thread(lambda: self.group_by(q).collect())

    # Changing documents.

    def _present(self, pks: list[str]) -> dict[str, Row]:
        asked = self._store.spark.createDataFrame([(k,) for k in pks], f"{PK} string")
        return {r[PK]: r for r in self.documents().join(F.broadcast(asked), PK, "left_semi").collect()}

    def _admit_batch(self, n: int) -> None:
        if (most := self._options.limits.batch) is not None and n > most:
            raise CairnError("resource_exhausted", f"a batch holds at most {most} documents")

    def _write(self, docs: list[dict[str, Any] | Record], how: str) -> list[WriteResult]:
        """Validate a batch, accept what is good, commit once."""
        with self._mutex:
            self._writable()
            self._admit_batch(len(docs))
            docs = [plain(d) for d in docs]
            keys = [k for d in docs if isinstance(k := d.get("id", d.get(PK)), str)]
            there = self._present(keys) if keys else {}
            results, rows, seen = [], [], set()
            for d in docs:
                key = d.get("id", d.get(PK))
                try:
                    made = documents.row(self.schema, d, whole=how != "update")
                    if key in seen or how == "insert" and key in there:
                        raise CairnError("already_exists", f"{key!r} exists")
                    if how == "update":
                        if key not in there:
                            raise CairnError("not_found", f"no document {key!r}")
                        old = there[key].asDict(recursive=True)
                        made = old | made | {NULLS: sorted(set(made[NULLS]) | set(old[NULLS] or []) - set(made))}
                    seen.add(key)
                    rows.append(made)
                    results.append(WriteResult(key, True))
                except CairnError as e:
                    results.append(WriteResult(str(key), False, e.code, e.message))
            if rows:
                schema = self.schema.spark
                frame = self._store.spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)
                self._append(frame, frame.select(PK) if how != "insert" else None, len(rows) - sum(k in there for k in seen))
            return results

    def _append(self, frame: DataFrame | None, gone: DataFrame | None, grown: int) -> None:
        part = (self._store.write(frame) if frame is not None else None, self._store.write(gone, "gone") if gone is not None else None)
        self._changed(evolved(self._manifest, parts=(*self._manifest.parts, part), count=self._manifest.count + grown))

    def insert(self, docs: list[dict[str, Any] | Record]) -> list[WriteResult]:
        """Add documents with new keys; one result per document."""
        return self._write(docs, "insert")

    def update(self, docs: list[dict[str, Any] | Record]) -> list[WriteResult]:
        """Change the given fields of existing documents; fields cannot be removed."""
        return self._write(docs, "update")

    def upsert(self, docs: list[dict[str, Any] | Record]) -> list[WriteResult]:
        """Put whole documents in place of any with their keys."""
        return self._write(docs, "upsert")

    def upsert_frame(self, frame: DataFrame, insert_only: bool = False) -> None:
        """Bulk upsert of a DataFrame with the collection's columns; nothing passes through the driver.
        Keys must be distinct and required fields present. ``insert_only``: no key may exist."""
        with self._mutex:
            self._writable()
            names = frame.columns
            full = frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.spark.fields))
            name = self._store.write(full)
            written = self._store.spark.read.schema(self.schema.spark).parquet(f"{self._store.root}/{name}")
            required = [PK, *(f.name for f in (*self.schema.fields, *self.schema.vectors) if not f.nullable)]
            facts = written.agg(F.count("*"), *(F.count(F.when(F.col(n).isNull(), 1)) for n in required)).first()
            repeated = written.groupBy(PK).count().where("count > 1").limit(1).count()
            old = self.documents().select(PK).join(written.select(PK), PK, "left_semi").count()
            if any(facts[1:]) or repeated or insert_only and old:
                self._store.delete(name)
                raise invalid("rows lack required fields or repeat keys")
            gone = self._store.write(written.select(PK), "gone") if old else None
            self._changed(evolved(self._manifest, parts=(*self._manifest.parts, (name, gone)), count=self._manifest.count + facts[0] - old))

    def delete(self, pks: list[str]) -> list[WriteResult]:
        with self._mutex:
            self._writable()
            self._admit_batch(len(pks))
            there = self._present(pks)
            results, gone = [], set()
            for k in pks:
                good = k in there and k not in gone
                results.append(WriteResult(k, good, "" if good else "not_found", "" if good else f"no document {k!r}"))
                gone.add(k)
            if there:
                self._append(None, self._store.spark.createDataFrame([(k,) for k in there], f"{PK} string"), -len(there))
            return results

    def delete_by_filter(self, text: str) -> None:
        with self._mutex:
            self._writable()
            name = self._store.write(filters.where(self.documents(), text).select(PK), "gone")
            n = self._store.spark.read.parquet(f"{self._store.root}/{name}").count()
            try:
                self._admit_batch(n)
            except CairnError:
                self._store.delete(name)
                raise
            self._changed(evolved(self._manifest, parts=(*self._manifest.parts, (None, name)), count=self._manifest.count - n))

    # Changing the schema: the new table is written and committed with it.

    def _rewrite(self, frame: DataFrame, schema: CollectionSchema) -> None:
        name = self._store.write(frame.select(*schema.spark.names))
        self._commit(evolved(self._manifest, schema=schema, parts=((name, None),)))

    def add_column(self, f: FieldSchema, default: str | None = None) -> None:
        with self._mutex:
            self._writable()
            if self.schema.field(f.name) or self.schema.vector(f.name):
                raise CairnError("already_exists", f"{f.name} exists")
            value = documents.default_of(f, default) if default is not None or f.nullable or self.count() else None
            df = self.documents().withColumn(f.name, F.lit(value).cast(f.spark))
            if value is None and default is not None:
                df = df.withColumn(NULLS, F.array_append(F.coalesce(NULLS, F.array().cast("array<string>")), f.name))
            self._rewrite(df, self.schema.with_field(f))

    add_column_with_options = add_column

    def drop_column(self, name: str) -> None:
        with self._mutex:
            self._writable()
            self._scalar(name)
            self._rewrite(self.documents().withColumn(NULLS, F.array_remove(NULLS, name)), self.schema.without(name))

    def rename_column(self, old: str, new: str) -> None:
        with self._mutex:
            self._writable()
            f = replace(self._scalar(old), name=new)
            if self.schema.field(new) or self.schema.vector(new):
                raise CairnError("already_exists", f"{new} exists")
            schema = replace(self.schema, fields=tuple(f if x.name == old else x for x in self.schema.fields))
            df = self.documents().withColumn(NULLS, F.transform(NULLS, lambda n: F.when(n == old, new).otherwise(n)))
            self._rewrite(df.withColumnRenamed(old, new), schema)

    def alter_column(self, f: FieldSchema) -> None:
        """Change a scalar's nullability or index; its type is fixed."""
        with self._mutex:
            self._writable()
            old = self._scalar(f.name)
            if old.type != f.type:
                raise unsupported("a column's type is fixed")
            if old.nullable and not f.nullable and self.documents().where(F.col(f.name).isNull()).limit(1).count():
                raise CairnError("failed_precondition", f"{f.name} has missing values")
            self._commit(evolved(self._manifest, schema=self.schema.with_field(f)))

    def _scalar(self, name: str) -> FieldSchema:
        if (f := self.schema.field(name)) is None:
            raise CairnError("not_found", f"no scalar column {name!r}")
        return f

    # Indexes.

    def create_index(self, name: str, params: IndexParams) -> None:
        """Set a field's index and build what it derives."""
        with self._mutex:
            self._writable()
            if v := self.schema.vector(name):
                schema = self.schema.with_vector(replace(v, index=params))
            else:
                schema = self.schema.with_field(replace(self._scalar(name), index=params))
            self._commit(evolved(self._manifest, schema=schema))
            self.rebuild_index(name)

    def drop_index(self, name: str) -> None:
        with self._mutex:
            self._writable()
            if v := self.schema.vector(name):
                schema = self.schema.with_vector(replace(v, index=None))
            else:
                schema = self.schema.with_field(replace(self._scalar(name), index=None))
            self._commit(evolved(self._manifest, schema=schema))

    def _index_name(self, name: str) -> str:
        return f"index-{name}-{self.schema.digest():08x}-{self.revision}"

    def _kept(self, df: DataFrame) -> DataFrame:
        """``df`` computed once for several uses."""
        return df.checkpoint() if self._store.spark.conf.get("spark.checkpoint.dir", None) else df.persist()

    def _covering(self, name: str) -> tuple[str, int] | None:
        """The folder of a field's derived tables and how many parts of this revision they cover: those of this
        schema whose parts this revision begins with. A checkpoint ends that until the next rebuild."""
        start = f"index-{name}-{self.schema.digest():08x}-"
        for folder in sorted((n for n in self._store.names() if n.startswith(start)), reverse=True):
            if self._store.exists(f"{folder}/_ready") and self._store.exists(f"{folder}/_parts"):
                parts = json.loads(self._store.read_text(f"{folder}/_parts"))
                if [list(p) for p in self._manifest.parts[: len(parts)]] == parts:
                    return folder, len(parts)
        return None

    def _text_index(self, name: str) -> fts.TextIndex | None:
        """A text field's postings, with later changes laid over them; None if queries must scan."""
        if (found := self._covering(name)) is None:
            return None
        folder, covered = found
        index = fts.TextIndex.read(self._store.spark, f"{self._store.root}/{folder}", self._store.read_text(f"{folder}/_ready"))
        if index is None or covered == len(self._manifest.parts):
            return index
        added, gone = self._store.changes(self._manifest, covered)
        return index.overlaid(added, gone, name, _analyzer(self.schema.field(name)), PK)

    def _near(self, name: str, index: IndexParams, probe: Any, q: SearchQuery, allowed: DataFrame | None) -> DataFrame | None:
        """Candidate keys of a vector field: those of its index without the keys changed since, and what was
        added since; None if there is no index to use."""
        if (found := self._covering(name)) is None:
            return None
        folder, covered = found
        near = ann.candidates(ann.load(self._store, folder), index, probe, index["metric"], q.topk, q.params, allowed)
        if covered < len(self._manifest.parts):
            added, gone = self._store.changes(self._manifest, covered)
            near = near.select(PK).join(gone, PK, "left_anti").union(added.select(PK))
        # Computed once for two uses; no broadcast is asked for, as the keys grow with the lists probed.
        return self._kept(near)

    def rebuild_index(self, name: str) -> None:
        with self._mutex:
            self._writable()
            folder = self._index_name(name)
            for old in self._store.names():
                if old.startswith(f"index-{name}-"):
                    self._store.delete(old)
            self._store.write_text(f"{folder}/_parts", json.dumps([list(p) for p in self._manifest.parts]))
            if (v := self.schema.vector(name)) and v.index and v.index.kind != "flat":
                ann.build(self._store, folder, self.documents().select(PK, F.col(name).cast("array<float>").alias("v")), v.index)
            elif (f := self.schema.field(name)) and f.index and f.index.kind == "fts":
                facts = fts.TextIndex.build(self.documents(), name, _analyzer(f), PK, f"{self._store.root}/{folder}")
                self._store.write_text(f"{folder}/_ready", facts)
            try:
                self._admit_index(name, folder)
            except CairnError:
                self._store.delete(folder)
                raise

    def _admit_index(self, name: str, folder: str) -> None:
        """An error if a field's derived tables are above a ceiling or the byte limit."""
        size, v, most = self._store.size(folder), self.schema.vector(name), self._options.limits.bytes
        self._config.ceilings.admit("index_cache_bytes", size)
        if v and v.index and v.index.kind == "diskann":
            self._config.ceilings.admit("diskann_file_bytes", size)
        if most is not None and self._bytes(self._manifest.parts) + sum(self._store.size(n) for n in self._store.names() if n.startswith("index-")) > most:
            raise CairnError("resource_exhausted", f"the collection is limited to {most} bytes")

    def optimize(self) -> None:
        """Checkpoint and rebuild every index."""
        with self._mutex:
            self.flush()
            for f in (*self.schema.fields, *self.schema.vectors):
                if f.index and f.index.kind not in ("flat", "invert"):
                    self.rebuild_index(f.name)

    # Facts and upkeep.

    def stats(self) -> dict[str, Any]:
        return {"revision": self.revision, "documents": self._manifest.count, "parts": len(self._manifest.parts), **self._counts}

    stats_snapshot = stats

    def health(self) -> dict[str, Any]:
        stale = [f.name for f in self.schema.vectors if f.index and f.index.kind != "flat" and (self._covering(f.name) or ("", -1))[1] < len(self._manifest.parts)]
        return {"open": self._open, "writable": not self._options.read_only, "stale_indexes": stale}

    def start_maintenance(self, interval: float = 60.0) -> Maintenance:
        """Optimize in the background, every ``interval`` seconds (10 ms to 365 days)."""
        return Maintenance(self, interval)


class Maintenance:
    """A background thread that optimizes a collection when it has more than one part."""

    def __init__(self, collection: Collection, interval: float) -> None:
        if not 0.01 <= interval <= 365 * 86400:
            raise invalid("interval must be 10 ms to 365 days")
        self._collection, self._interval = collection, interval
        self._wake, self._stop, self.runs, self.errors = threading.Event(), False, 0, 0
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        while not self._stop:
            self._wake.wait(self._interval)
            self._wake.clear()
            if self._stop or not self._collection.is_open:
                return
            try:
                if self._collection.stats()["parts"] > 1:
                    self._collection.optimize()
                self.runs += 1
            except Exception:  # the next round tries again; health() tells
                self.errors += 1

    def trigger(self) -> None:
        self._wake.set()

    def health(self) -> dict[str, Any]:
        return {"alive": self._thread.is_alive(), "runs": self.runs, "errors": self.errors, "time": time.time()}

    def close(self) -> None:
        self._stop = True
        self._wake.set()
        self._thread.join()


def _analyzer(f: FieldSchema | None) -> Analyzer:
    if f and f.index and f.index.kind == "fts":
        return Analyzer(f.index["tokenizer"], f.index["filters"], f.index["extra"])
    return Analyzer()

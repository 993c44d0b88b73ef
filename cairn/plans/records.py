"""Documents with typed access: what ``insert``, ``update`` and ``upsert`` take besides dicts.

``add_<type>`` and ``get_<type>`` exist for every scalar and vector type, for example ``add_int32`` and
``get_vector_fp32``. Adding checks the value at once; getting a value of another type is an error, and an
absent or null one is None.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import partialmethod
from typing import Any

import numpy as np
from pyspark.sql import Row

from cairn.errors import invalid
from cairn.plans import documents
from cairn.schema import NULLS, PK, SCALARS, VECTORS, CollectionSchema, VectorSchema


class Record:
    """A key, typed fields and vectors, and the score of a result."""

    def __init__(self, key: str = "") -> None:
        self.key, self.score, self.doc_id = key, 0.0, None
        self._held: dict[str, tuple[str | None, Any]] = {}

    @classmethod
    def of(cls, row: Row, schema: CollectionSchema) -> Record:
        """The document of a result row. Without ``_nulls``, which results do not show, nulls count as absent."""
        given = row.asDict(recursive=True)
        out = cls(given[PK])
        out.score, out.doc_id = given.get("_score", 0.0), given.get("_doc_id")
        for f in (*schema.fields, *schema.vectors):
            if given.get(f.name) is not None:
                out._held[f.name] = f.type, given[f.name]
            elif f.name in (given.get(NULLS) or ()):
                out.set_null(f.name)
        return out

    def _add(self, kind: str, name: str, value: Any) -> Record:
        if not name:
            raise invalid("a field needs a name")
        if kind in SCALARS:
            held = documents.scalar(kind, value)
        else:
            binary = kind.startswith("vector_binary")
            dimension = 0 if kind.startswith("sparse") else len(value) * (8 if binary else 1)
            held = documents.vector(VectorSchema(name, kind, dimension), value)
        self._held[name] = kind, held
        return self

    def _get(self, kind: str, name: str) -> Any:
        found, value = self._held.get(name, (None, None))
        if found not in (None, kind):
            raise invalid(f"{name} is {found}, not {kind}")
        return value

    def set_null(self, name: str) -> Record:
        self._held[name] = None, None
        return self

    def remove(self, name: str) -> None:
        self._held.pop(name, None)

    def clear(self) -> None:
        self._held.clear()

    def has(self, name: str) -> bool:
        return name in self._held

    def is_null(self, name: str) -> bool:
        return self._held.get(name) == (None, None)

    def __len__(self) -> int:
        return len(self._held)

    def set_score(self, score: float) -> None:
        if not math.isfinite(score):
            raise invalid("a score must be finite")
        self.score = float(score)

    def _vector(self, name: str) -> tuple[str, Any]:
        kind, value = self._held.get(name, (None, None))
        if kind not in VECTORS:
            raise invalid(f"{name} is no vector")
        return kind, value

    def dimension(self, name: str) -> int:
        """Values of a dense vector, bits of a binary one, the largest index and one of a sparse one."""
        kind, value = self._vector(name)
        if kind.startswith("sparse"):
            return max(value["indices"]) + 1
        return len(value) * (8 if kind.startswith("vector_binary") else 1)

    def to_dense(self, name: str, narrow: bool = False) -> list[float] | None:
        """A numeric dense vector as doubles, or rounded to single precision; None for other vectors, and for
        values that single precision cannot hold."""
        kind, value = self._vector(name)
        if kind.startswith(("sparse", "vector_binary")):
            return None
        if not narrow:
            return [float(v) for v in value]
        with np.errstate(over="ignore"):
            out = np.asarray(value, np.float32)
        return out.astype(float).tolist() if np.isfinite(out).all() else None

    def to_sparse(self, name: str) -> dict[int, float] | None:
        """A sparse vector by index; None for other vectors."""
        kind, value = self._vector(name)
        return dict(zip(value["indices"], value["values"], strict=True)) if kind.startswith("sparse") else None

    def to_dict(self) -> dict[str, Any]:
        """The document as ``Collection.insert`` takes it as a dict."""
        plain = lambda kind, v: int(v) if kind == "uint64" else [int(x) for x in v] if kind == "array_uint64" else v
        return {"id": self.key} | {name: plain(kind, v) for name, (kind, v) in self._held.items()}


for _kind in (*SCALARS, *VECTORS):
    setattr(Record, f"add_{_kind}", partialmethod(Record._add, _kind))
    setattr(Record, f"get_{_kind}", partialmethod(Record._get, _kind))


def plain(doc: Mapping[str, Any] | Record) -> dict[str, Any]:
    return doc.to_dict() if isinstance(doc, Record) else dict(doc)


def encode_fp16(values: Iterable[float]) -> list[int]:
    """The 16-bit patterns of values in half precision, rounded to nearest even; overflow is an error."""
    return np.array([documents.half(v) for v in values], np.float16).view(np.uint16).tolist()


def decode_fp16(bits: Iterable[int]) -> list[float]:
    return np.array(list(bits), np.uint16).view(np.float16).astype(float).tolist()

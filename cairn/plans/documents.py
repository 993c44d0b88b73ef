"""Validation of documents given as dicts, and their rows.

A document has its key under ``id``. A key with value None is explicitly null; a missing key is absent.
"""

from __future__ import annotations

import base64
import math
from decimal import Decimal
from typing import Any

import numpy as np

from cairn.errors import CairnError, invalid
from cairn.schema import NULLS, PK, RANGES, VECTOR_RANGES, CollectionSchema, FieldSchema, VectorSchema


def scalar(kind: str, value: Any) -> Any:
    """``value`` as a scalar of a type, or an error; text from JSON counts as base64 for binary."""
    if kind.startswith("array_"):
        if not isinstance(value, (list, tuple)):
            raise invalid(f"{kind} needs a list")
        return [scalar(kind[6:], v) for v in value]
    if value is None:
        raise invalid("null element")
    if kind == "binary":
        if isinstance(value, str):
            try:
                return bytearray(base64.b64decode(value, validate=True))
            except ValueError as e:
                raise invalid("binary text must be base64") from e
        if isinstance(value, (bytes, bytearray)):
            return bytearray(value)
    elif kind == "string" and isinstance(value, str):
        return value
    elif kind == "bool" and isinstance(value, bool):
        return value
    elif kind in RANGES and isinstance(value, int) and not isinstance(value, bool):
        low, high = RANGES[kind]
        if not low <= value <= high:
            raise invalid(f"{value} is no {kind}")
        return Decimal(value) if kind == "uint64" else value
    elif kind in ("float", "double") and isinstance(value, (int, float)) and not isinstance(value, bool):
        if not math.isfinite(value) or kind == "float" and abs(value) > 3.4028235e38:
            raise invalid(f"{value} is no finite {kind}")
        return float(value)
    raise invalid(f"{value!r} is no {kind}")


def vector(f: VectorSchema, value: Any) -> Any:
    """``value`` as a vector of a field, or an error."""
    if f.binary:
        if not isinstance(value, (bytes, bytearray)) or 8 * len(value) != f.dimension:
            raise invalid(f"{f.name} needs {f.dimension} bits")
        return bytearray(value)
    if f.sparse:
        pairs = list(zip(value["indices"], value["values"], strict=True)) if isinstance(value, dict) and set(value) == {"indices", "values"} else list(dict(value).items())
        items = dict(pairs)
        if not items or len(items) < len(pairs):
            raise invalid(f"{f.name} needs distinct indices")
        if any(not isinstance(i, int) or i < 0 or f.dimension and i >= f.dimension for i in items) or not all(map(math.isfinite, items.values())):
            raise invalid(f"{f.name} has an index or value out of range")
        pairs = sorted(items.items())
        return {"indices": [i for i, _ in pairs], "values": [half(v) if f.type.endswith("fp16") else float(v) for _, v in pairs]}
    if not isinstance(value, (list, tuple, np.ndarray)) or len(value) != f.dimension:
        raise invalid(f"{f.name} needs {f.dimension} values")
    if f.type in VECTOR_RANGES:
        low, high = VECTOR_RANGES[f.type]
        if any(int(v) != v or not low <= v <= high for v in value):
            raise invalid(f"{f.name} has a value out of range")
        return [int(v) for v in value]
    if not all(math.isfinite(v) for v in value):
        raise invalid(f"{f.name} must be finite")
    return [half(v) for v in value] if f.type == "vector_fp16" else [float(v) for v in value]


def half(value: float) -> float:
    """Rounded to half precision, nearest even; overflow is an error."""
    out = float(np.float16(value))
    if not math.isfinite(out):
        raise invalid(f"{value} does not fit half precision")
    return out


def row(schema: CollectionSchema, doc: dict[str, Any], whole: bool = True) -> dict[str, Any]:
    """The row of a document. ``whole``: required fields must be there; otherwise it is a patch."""
    known = {PK, "id"} | {f.name for f in (*schema.fields, *schema.vectors)}
    if bad := set(doc) - known:
        raise invalid(f"unknown fields {sorted(bad)}")
    key = doc.get("id", doc.get(PK))
    if not isinstance(key, str) or not key:
        raise invalid("a document needs a non-empty string id")
    out: dict[str, Any] = {PK: key, NULLS: []}
    for f in schema.fields:
        if f.name not in doc:
            if whole and not f.nullable:
                raise invalid(f"{f.name} is required")
        elif doc[f.name] is None:
            if not f.nullable:
                raise invalid(f"{f.name} cannot be null")
            out[f.name] = None
            out[NULLS].append(f.name)
        else:
            out[f.name] = scalar(f.type, doc[f.name])
    for v in schema.vectors:
        if doc.get(v.name) is not None:
            out[v.name] = vector(v, doc[v.name])
        elif whole and not v.sparse:
            raise invalid(f"{v.name} is required")
    return out


def default_of(f: FieldSchema, expression: str | None) -> Any:
    """The value of a default expression: null, true, false, a quoted string or a number."""
    if expression is None or expression.strip().lower() == "null":
        if not f.nullable:
            raise CairnError("failed_precondition", f"{f.name} needs a default")
        return None
    text = expression.strip()
    if text.lower() in ("true", "false"):
        return scalar(f.type, text.lower() == "true")
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return scalar(f.type, text[1:-1])
    try:
        return scalar(f.type, float(text) if f.type in ("float", "double") else int(text))
    except ValueError as e:
        raise invalid(f"{expression!r} is no default") from e

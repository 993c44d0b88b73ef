"""Collection schemas: typed scalar and vector fields, index parameters, and their checks."""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from cairn.errors import invalid, unsupported

PK = "_pk"
NULLS = "_nulls"

# Scalar types with their Spark types, and vector types with those of their values.
SCALARS: dict[str, T.DataType] = {
    "binary": T.BinaryType(), "string": T.StringType(), "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(),
}
SCALARS |= {f"array_{k}": T.ArrayType(v) for k, v in list(SCALARS.items())}
_SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
VECTORS: dict[str, T.DataType] = {
    "vector_fp16": T.ArrayType(T.FloatType()), "vector_fp32": T.ArrayType(T.FloatType()), "vector_fp64": T.ArrayType(T.DoubleType()),
    "vector_int4": T.ArrayType(T.ByteType()), "vector_int8": T.ArrayType(T.ByteType()), "vector_int16": T.ArrayType(T.ShortType()),
    "vector_binary32": T.BinaryType(), "vector_binary64": T.BinaryType(), "sparse_vector_fp16": _SPARSE, "sparse_vector_fp32": _SPARSE,
}
RANGES = {"int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1), "uint32": (0, (1 << 32) - 1), "uint64": (0, (1 << 64) - 1)}
VECTOR_RANGES = {"vector_int4": (-8, 7), "vector_int8": (-128, 127), "vector_int16": (-32768, 32767)}
METRICS = {"l2": "l2", "euclidean": "l2", "ip": "ip", "inner_product": "ip", "dot": "ip", "cosine": "cosine", "mips_l2": "mips_l2", "mips-l2": "mips_l2"}
#: What each kind of index may be given.
INDEX_PARAMS: dict[str, dict[str, Any]] = {
    "flat": {"metric": "cosine", "quantize": "none"},
    "hnsw": {"metric": "cosine", "m": 16, "ef_construction": 96, "quantize": "none"},
    "ivf": {"metric": "cosine", "n_lists": 16, "n_iters": 3, "use_soar": False, "quantize": "none"},
    "hnsw_rabitq": {"metric": "cosine", "m": 16, "ef_construction": 96, "bits": 7},
    "ivf_rabitq": {"metric": "cosine", "n_lists": 16, "bits": 7},
    "vamana": {"metric": "l2", "max_degree": 32, "list_size": 64, "alpha": 1.2, "max_occlusion": 750, "saturate": False},
    "diskann": {"metric": "l2", "max_degree": 32, "list_size": 64, "alpha": 1.2, "pq_chunk_num": 0},
    "invert": {"range_optimized": True, "wildcard_optimized": True},
    "fts": {"tokenizer": "standard", "filters": ("lowercase",), "extra": {}},
}


def metric_name(name: str) -> str:
    if (m := METRICS.get(name.lower())) is None:
        raise invalid(f"unknown metric {name!r}")
    return m


@dataclass(frozen=True)
class IndexParams:
    """A kind of index and its parameters, defaults filled in."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in INDEX_PARAMS:
            raise invalid(f"unknown index kind {self.kind!r}")
        known = INDEX_PARAMS[self.kind]
        if extra := set(self.params) - set(known):
            raise invalid(f"{self.kind} index does not take {sorted(extra)}")
        full = known | self.params
        if "metric" in full:
            full["metric"] = metric_name(full["metric"])
        if full.get("quantize", "none") not in ("none", "fp16", "int8", "int4"):
            raise invalid(f"unknown quantizer {full['quantize']!r}")
        for name in ("m", "ef_construction", "n_lists", "max_degree", "list_size", "max_occlusion"):
            if name in full and int(full[name]) <= 0:
                raise invalid(f"{name} must be positive")
        if "bits" in full and not 1 <= full["bits"] <= 9:
            raise invalid("bits must be 1 to 9")
        object.__setattr__(self, "params", full)

    def __getitem__(self, name: str) -> Any:
        return self.params[name]


def _checked_name(name: str) -> None:
    if not name or name in (PK, NULLS):
        raise invalid(f"field name {name!r} cannot be used")


@dataclass(frozen=True)
class FieldSchema:
    """A scalar field."""

    name: str
    type: str
    nullable: bool = False
    index: IndexParams | None = None

    def __post_init__(self) -> None:
        _checked_name(self.name)
        if self.type not in SCALARS:
            raise invalid(f"{self.type!r} is no scalar type")
        if self.index and self.index.kind not in ("invert", "fts"):
            raise unsupported(f"a scalar field cannot have a {self.index.kind} index")
        if self.index and self.index.kind == "fts" and self.type != "string":
            raise unsupported("full-text indexes need a string field")

    @property
    def spark(self) -> T.DataType:
        return SCALARS[self.type]


@dataclass(frozen=True)
class VectorSchema:
    """A vector field: dense ones are required, sparse ones optional. Dimensions of binary vectors are bits."""

    name: str
    type: str
    dimension: int
    index: IndexParams | None = None

    def __post_init__(self) -> None:
        _checked_name(self.name)
        if self.type not in VECTORS:
            raise invalid(f"{self.type!r} is no vector type")
        if self.dimension < (0 if self.sparse else 1):
            raise invalid("dimension must be positive")
        if self.binary and self.dimension % int(self.type[-2:]):
            raise invalid(f"dimension must be a multiple of {self.type[-2:]}")
        if self.index and self.index.kind not in ("flat",) and (self.sparse or self.binary):
            raise unsupported("approximate indexes need a dense numeric vector")

    @property
    def sparse(self) -> bool:
        return self.type.startswith("sparse")

    @property
    def binary(self) -> bool:
        return self.type.startswith("vector_binary")

    @property
    def nullable(self) -> bool:
        return self.sparse

    @property
    def spark(self) -> T.DataType:
        return VECTORS[self.type]


@dataclass(frozen=True)
class CollectionSchema:
    """Named, ordered scalar and vector fields."""

    name: str
    fields: tuple[FieldSchema, ...] = ()
    vectors: tuple[VectorSchema, ...] = ()

    def __post_init__(self) -> None:
        if not self.name:
            raise invalid("a collection needs a name")
        names = [f.name for f in (*self.fields, *self.vectors)]
        if len(set(names)) < len(names):
            raise invalid("field names repeat")

    def field(self, name: str) -> FieldSchema | None:
        return next((f for f in self.fields if f.name == name), None)

    def vector(self, name: str) -> VectorSchema | None:
        return next((f for f in self.vectors if f.name == name), None)

    def with_field(self, f: FieldSchema) -> CollectionSchema:
        return replace(self, fields=(*(x for x in self.fields if x.name != f.name), f)) if self.field(f.name) is None else replace(self, fields=tuple(f if x.name == f.name else x for x in self.fields))

    def with_vector(self, v: VectorSchema) -> CollectionSchema:
        return replace(self, vectors=tuple(v if x.name == v.name else x for x in self.vectors))

    def without(self, name: str) -> CollectionSchema:
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))

    @property
    def spark(self) -> T.StructType:
        columns = [T.StructField(PK, T.StringType(), False), *(T.StructField(f.name, f.spark) for f in (*self.fields, *self.vectors))]
        return T.StructType([*columns, T.StructField(NULLS, T.ArrayType(T.StringType()))])

    def to_json(self) -> dict[str, Any]:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> CollectionSchema:
        index = lambda x: x and IndexParams(x["kind"], {k: tuple(v) if isinstance(v, list) else v for k, v in x["params"].items()})
        make = lambda kind, rows: tuple(kind(**r | {"index": index(r["index"])}) for r in rows)
        return cls(data["name"], make(FieldSchema, data["fields"]), make(VectorSchema, data["vectors"]))

    def digest(self) -> int:
        return zlib.crc32(json.dumps(self.to_json(), sort_keys=True).encode())

"""Query objects, their builders, and the contract they are checked against."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from cairn.errors import invalid, unsupported
from cairn.schema import CollectionSchema, VectorSchema, metric_name

#: What each kind of index takes at query time, with the value that means unset.
CONTROLS: dict[str, dict[str, Any]] = {
    "flat": {},
    "hnsw": {"ef": 0, "radius": 0.0, "is_linear": False, "is_using_refiner": False},
    "ivf": {"nprobe": 0, "scale_factor": 0.0, "is_linear": False},
    "ivf_rabitq": {"nprobe": 0, "scale_factor": 4.0, "radius": 0.0, "is_linear": False, "is_using_refiner": False},
    "hnsw_rabitq": {"ef": 0, "radius": 0.0, "is_linear": False, "is_using_refiner": False},
    "vamana": {"list_size": 0, "is_linear": False},
    "diskann": {"list_size": 0, "is_linear": False},
    "fts": {"default_operator": "or"},
}


@dataclass(frozen=True)
class SearchQuery:
    """One route: exactly one of vector, sparse, binary, source_id, match_string, query_string."""

    field_name: str
    topk: int = 10
    vector: tuple[float, ...] | None = None
    sparse: tuple[tuple[int, float], ...] | None = None
    binary: bytes | None = None
    source_id: str | None = None
    match_string: str | None = None
    query_string: str | None = None
    filter: str | None = None
    radius: float | None = None
    metric: str | None = None
    output_fields: tuple[str, ...] | None = None
    include_vector: bool = False
    include_doc_id: bool = False
    params: dict[str, Any] = field(default_factory=dict)

    def where(self, text: str | None) -> SearchQuery:
        return replace(self, filter=text if text and text.strip() else None)

    def limit(self, k: int) -> SearchQuery:
        return replace(self, topk=k)

    def within(self, radius: float) -> SearchQuery:
        return replace(self, radius=radius)

    def select(self, *names: str, include_vector: bool = False) -> SearchQuery:
        return replace(self, output_fields=names or None, include_vector=include_vector)

    def controls(self, **params: Any) -> SearchQuery:
        return replace(self, params=self.params | params)

    @property
    def route(self) -> str:
        routes = [r for r in ("vector", "sparse", "binary", "source_id", "match_string", "query_string") if getattr(self, r) is not None]
        if len(routes) != 1:
            raise invalid(f"a query has exactly one route, not {routes or 'none'}")
        return routes[0]


def dense(field_name: str, vector, topk: int = 10) -> SearchQuery:
    return SearchQuery(field_name, topk, vector=tuple(float(x) for x in vector))


def sparse(field_name: str, items: dict[int, float], topk: int = 10) -> SearchQuery:
    return SearchQuery(field_name, topk, sparse=tuple(sorted(items.items())))


def binary(field_name: str, bits: bytes, topk: int = 10) -> SearchQuery:
    return SearchQuery(field_name, topk, binary=bits)


def by_id(field_name: str, source_id: str, topk: int = 10) -> SearchQuery:
    return SearchQuery(field_name, topk, source_id=source_id)


def match(field_name: str, text: str, topk: int = 10, operator: str = "or") -> SearchQuery:
    return SearchQuery(field_name, topk, match_string=text, params={"default_operator": operator})


def query_string(field_name: str, text: str, topk: int = 10, operator: str = "or") -> SearchQuery:
    return SearchQuery(field_name, topk, query_string=text, params={"default_operator": operator})


@dataclass(frozen=True)
class MultiQuery:
    """1 to 1024 routes on one revision, fused."""

    branches: tuple[SearchQuery, ...]
    topk: int = 10
    method: str = "rrf"
    rank_constant: float = 60.0
    weights: tuple[float, ...] = ()
    normalize: str = "none"
    filter: str | None = None
    output_fields: tuple[str, ...] | None = None
    include_vector: bool = False

    def __post_init__(self) -> None:
        if not 1 <= len(self.branches) <= 1024:
            raise invalid("a multi-query has 1 to 1024 branches")
        if len(self.weights) > len(self.branches):
            raise invalid("more weights than branches")
        if self.rank_constant <= 0:
            raise invalid("the rank constant must be positive")


@dataclass(frozen=True)
class GroupByQuery:
    """Grouped top-k over a dense or binary route."""

    query: SearchQuery
    group_by: str
    group_count: int = 10
    group_topk: int = 1

    def __post_init__(self) -> None:
        if self.query.route not in ("vector", "binary"):
            raise unsupported("grouping needs a dense or binary route")
        if self.group_count <= 0 or self.group_topk <= 0:
            raise invalid("group limits must be positive")


def metric_of(query: SearchQuery, vector: VectorSchema) -> str:
    """The query's metric, else the index's, else L2 for binary vectors and cosine for others."""
    named = query.metric or (vector.index.params.get("metric") if vector.index else None)
    return metric_name(named) if named else "l2" if vector.binary else "cosine"


def validated(query: SearchQuery, schema: CollectionSchema) -> None:
    """Refuse a query that the schema does not support."""
    if query.topk <= 0:
        raise invalid("topk must be positive")
    route = query.route
    if route in ("match_string", "query_string"):
        f = schema.field(query.field_name)
        if f is None or f.type != "string":
            raise invalid(f"{query.field_name!r} is no text field")
        allowed = CONTROLS["fts"]
        if query.params.get("default_operator", "or").lower() not in ("or", "and"):
            raise invalid("default_operator is or / and")
        if query.radius is not None:
            raise invalid("full-text queries take no radius")
    else:
        v = schema.vector(query.field_name)
        if v is None:
            raise invalid(f"{query.field_name!r} is no vector field")
        good = {"vector": not v.sparse and not v.binary, "sparse": v.sparse, "binary": v.binary, "source_id": True}[route]
        if not good:
            raise invalid(f"{query.field_name!r} does not take a {route} query")
        if route == "vector" and len(query.vector or ()) != v.dimension:
            raise invalid(f"query has {len(query.vector or ())} dimensions, {query.field_name!r} {v.dimension}")
        if route == "binary" and 8 * len(query.binary or b"") != v.dimension:
            raise invalid("binary query has another number of bits")
        if route == "sparse" and v.dimension and any(not 0 <= i < v.dimension for i, _ in query.sparse or ()):
            raise invalid("sparse index out of range")
        if v.binary and metric_of(query, v) != "l2":
            raise unsupported("binary vectors have the L2 metric only")
        if query.radius is not None and metric_of(query, v) == "l2" and query.radius < 0 and not v.binary:
            raise invalid("an L2 radius cannot be negative")
        allowed = CONTROLS[v.index.kind if v.index else "flat"]
    if bad := set(query.params) - set(allowed):
        raise (unsupported if not allowed else invalid)(f"query controls {sorted(bad)} do not apply")

"""The filter language: text to an expression tree, and the tree to a two-valued Column.

Precedence is ``or < and < not``. A leaf is ``field OP literal``; ``id`` names the primary key. A leaf
over a missing value is false, not null, so NOT of it is true; ``where`` nevertheless hands positive
top-level conjuncts to Spark bare, so that they reach the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import invalid
from cairn.schema import NULLS, PK

_TOKEN = re.compile(r"""\s*(?:(?P<num>-?[0-9][0-9.]*)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>&&|\|\||!=|==|<=|>=|[=<>!()\[\],])|(?P<word>[^\W\d][\w.]*))""", re.S)
_WORD_OPS = ("in", "like", "is_null", "contain_all", "has_prefix", "has_suffix")


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise invalid(f"filter: unexpected {text[at:].strip()[:20]!r}")
            kind, raw = m.lastgroup, m[m.lastgroup]
            if kind == "num":
                try:
                    self.tokens.append(("lit", float(raw)))
                except ValueError:
                    raise invalid(f"filter: {raw!r} is no number") from None
            elif kind == "str":
                self.tokens.append(("lit", re.sub(r"\\(.)", r"\1", raw[1:-1], flags=re.S)))
            elif kind == "op":
                self.tokens.append(("op", {"&&": "and", "||": "or", "!": "not", "=": "=="}.get(raw, raw)))
            else:
                low = raw.lower()
                self.tokens.append(("lit", {"true": True, "false": False, "null": None}[low]) if low in ("true", "false", "null") else ("op", low) if low in ("and", "or", "not", *_WORD_OPS) else ("name", raw))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str, value: Any = ...) -> Any:
        got = self.peek()
        if got[0] != kind or value is not ... and got[1] != value:
            raise invalid(f"filter: expected {kind if value is ... else value}, found {got[1]!r}")
        self.at += 1
        return got[1]

    def is_op(self, value: str) -> bool:
        return self.peek() == ("op", value)

    def chain(self, word: str, below, make) -> Any:
        parts = [below()]
        while self.is_op(word):
            self.at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def any(self) -> Any:
        return self.chain("or", self.all, Any_)

    def all(self) -> Any:
        return self.chain("and", self.negated, All)

    def negated(self) -> Any:
        if self.is_op("not"):
            self.at += 1
            return Not(self.negated())
        if self.is_op("("):
            self.at += 1
            inner = self.any()
            self.take("op", ")")
            return inner
        return self.leaf()

    def list(self) -> list:
        self.take("op", "[")
        out: list = []
        while not self.is_op("]"):
            if out:
                self.take("op", ",")
            out.append(self.take("lit"))
        self.take("op", "]")
        return out

    def leaf(self) -> Any:
        name = self.take("name")
        turned = self.is_op("not")
        self.at += turned
        op = self.take("op")
        if op in ("in", "contain_all"):
            leaf = Leaf(name, op, self.list())
        elif op == "is_null":
            leaf = Leaf(name, op)
        elif op in ("like", "has_prefix", "has_suffix"):
            value = self.take("lit")
            if not isinstance(value, str):
                raise invalid(f"filter: {op} needs a string")
            leaf = Leaf(name, op, value)
        elif op in ("==", "!=", "<", "<=", ">", ">=") and not turned:
            leaf = Leaf(name, op, self.take("lit"))
        else:
            raise invalid(f"filter: {op!r} is no operator here")
        return Not(leaf) if turned else leaf


def parse(text: str) -> Any:
    """The expression tree of a filter; an empty one is an error."""
    p = _Parser(text)
    if not p.tokens:
        raise invalid("filter is empty")
    tree = p.any()
    if p.peek()[0] != "end":
        raise invalid(f"filter: unexpected {p.peek()[1]!r}")
    return tree


def _number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


class Compiler:
    """Columns for expression trees over frames of one schema."""

    def __init__(self, schema: T.StructType, pk: str = PK) -> None:
        self._types = {f.name: f.dataType for f in schema.fields}
        self._pk = pk

    def _column(self, name: str) -> tuple[Column, T.DataType, Column]:
        """The field, its type, and whether it is explicitly null."""
        real = self._pk if name == "id" else name
        if real not in self._types:
            return F.lit(None).cast("string"), T.NullType(), F.lit(False)
        col, kind = F.col(f"`{real}`"), self._types[real]
        if isinstance(kind, T.BinaryType):
            col, kind = F.base64(col), T.StringType()
        marked = F.coalesce(F.array_contains(NULLS, real), F.lit(False)) if NULLS in self._types else F.lit(False)
        return col, kind, col.isNull() & marked

    @staticmethod
    def _comparable(kind: T.DataType, value: Any) -> bool:
        if isinstance(value, bool):
            return isinstance(kind, T.BooleanType)
        return isinstance(value, str) and isinstance(kind, T.StringType) or isinstance(value, float) and _number(kind)

    @staticmethod
    def _pair(col: Column, kind: T.DataType, value: Any) -> tuple[Column, Column]:
        """Both sides as doubles, or as integers where that is the same and the scan can use it."""
        if isinstance(value, float):
            if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) and value.is_integer() and abs(value) < 2**31:
                return col, F.lit(int(value))
            return (col if isinstance(kind, T.DoubleType) else col.cast("double")), F.lit(value)
        return col, F.lit(value)

    def _raw(self, leaf: Leaf) -> Column:
        """The leaf, null where a missing value leaves it undecided (that is: false)."""
        col, kind, explicit = self._column(leaf.field)
        v = leaf.value
        if leaf.op == "is_null":
            return col.isNull()
        if leaf.op == "==":
            return explicit if v is None else self._equal(col, kind, v)
        if leaf.op == "!=":
            if v is None:
                return col.isNotNull()
            if not self._comparable(kind, v):
                return col.isNotNull() | explicit
            a, b = self._pair(col, kind, v)
            return (a != b) | explicit
        if leaf.op in ("<", "<=", ">", ">="):
            if isinstance(v, bool) or v is None or not self._comparable(kind, v):
                return F.lit(False)
            a, b = self._pair(col, kind, v)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[leaf.op]
        if leaf.op == "in":
            good = [x for x in v if x is not None and self._comparable(kind, x)]
            whole = isinstance(kind, (T.IntegerType, T.LongType)) and all(isinstance(x, float) and x.is_integer() and abs(x) < 2**31 for x in good)
            if not good:
                found = F.lit(False)
            elif whole:
                found = col.isin([int(x) for x in good])
            else:
                found = (col.cast("double") if _number(kind) else col).isin(good)
            return F.coalesce(found, F.lit(False)) | explicit if None in v else found
        if leaf.op == "contain_all":
            if not isinstance(kind, T.ArrayType):
                return F.lit(False)
            if not v:
                return col.isNotNull()
            inner = kind.elementType
            if isinstance(inner, T.BinaryType):
                col, inner = F.transform(col, F.base64), T.StringType()
            if not all(self._comparable(inner, x) for x in v):
                return F.lit(False)
            if _number(inner):
                col = col.cast("array<double>")
            return F.size(F.array_except(F.array(*(F.lit(x) for x in v)), col)) == 0
        if not isinstance(kind, T.StringType):
            return F.lit(False)
        if leaf.op == "like":
            return col.like(v.replace("\\", "\\\\").replace("*", "%"))
        return col.startswith(v) if leaf.op == "has_prefix" else col.endswith(v)

    def _equal(self, col: Column, kind: T.DataType, value: Any) -> Column:
        if not self._comparable(kind, value):
            return F.lit(False)
        a, b = self._pair(col, kind, value)
        return a == b

    def column(self, tree: Any) -> Column:
        """The tree as a Column that is never null."""
        if isinstance(tree, Not):
            return ~self.column(tree.of)
        if isinstance(tree, (All, Any_)):
            out = self.column(tree.parts[0])
            for part in tree.parts[1:]:
                out = out & self.column(part) if isinstance(tree, All) else out | self.column(part)
            return out
        return F.coalesce(self._raw(tree), F.lit(False))

    def conjuncts(self, tree: Any) -> list[Column]:
        """Conditions that together select what ``column`` does, positive leaves bare for pushdown."""
        if isinstance(tree, All):
            return [c for part in tree.parts for c in self.conjuncts(part)]
        return [self._raw(tree) if isinstance(tree, Leaf) else self.column(tree)]


def where(df: DataFrame, text: str | None, pk: str = PK) -> DataFrame:
    """The rows of ``df`` that a filter selects; None selects all."""
    if text is None:
        return df
    for condition in Compiler(df.schema, pk).conjuncts(parse(text)):
        df = df.where(condition)
    return df

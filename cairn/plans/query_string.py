"""Structured full-text queries: text to an expression tree.

Operators bind as OR < AND / NOT < adjacency (the default operator) < + / - < ~n ^b. A parenthesised
single negative clause loses its sign, as the outer clause sets its own.

The text is cut by one regular expression. One loop then reads the tokens with a stack of open groups;
a group keeps what each level of binding has finished, so no level needs a function of its own, and
nesting is bounded by memory alone. What a tree must fulfil as a whole is checked on the finished tree.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from typing import Any

from cairn.errors import invalid, unsupported
from cairn.functions.analysis import Analyzer

MAX_FUZZY, MAX_FUZZY_CHARS, MAX_SLOP, MAX_BOOST = 2, 256, 1024, 1e6

_TOKEN = re.compile(
    r"""\s+
    | (?P<mark> [-+()\[\]{}:^~] )
    | (?P<quote> ["'] ) (?P<phrase> (?: \\[\s\S] | (?!(?P=quote)) [^\\\r\n] )* ) (?P=quote)
    | (?P<word> (?: \\[\s\S] | [^\s\\"'()\[\]{}:^~+-] )+ )
    """,
    re.X,
)
_PIECE = re.compile(r"\\(?P<escaped>[\s\S])|(?P<wild>[*?])|(?P<plain>[^\\*?]+)")
_KEYWORDS = ("AND", "OR", "NOT")
_STARTS = ("word", "phrase", "(", "[", "{")


@dataclass(frozen=True)
class Node:
    """kind: empty, all, term, match, phrase, and, or. sign: '', '+' or '-'."""

    kind: str
    value: Any = None
    parts: tuple[Node, ...] = ()
    sign: str = ""
    boost: float = 1.0


@dataclass(frozen=True)
class Matcher:
    """Which vocabulary terms a pattern stands for: wildcard (regex source), fuzzy, or range."""

    kind: str
    pattern: str = ""
    distance: int = 0
    lower: tuple[str, bool] | None = None
    upper: tuple[str, bool] | None = None


@dataclass(frozen=True)
class Word:
    """A word's pieces: ("", literal), ("*", "") or ("?", "")."""

    pieces: tuple[tuple[str, str], ...]
    escaped: bool

    @property
    def wild(self) -> bool:
        return any(k for k, _ in self.pieces)

    @property
    def plain(self) -> str:
        return "".join(s for _, s in self.pieces)

    @property
    def anything(self) -> bool:
        return self.pieces == (("*", ""),)


def _word(raw: str) -> Word:
    pieces: list[tuple[str, str]] = []
    for m in _PIECE.finditer(raw):
        if m["plain"] and (bad := re.search("[&|]", m["plain"])):
            raise unsupported(f"{bad[0]!r} is no query syntax")
        if m["wild"]:
            pieces.append((m["wild"], ""))
        elif pieces and not pieces[-1][0]:
            pieces[-1] = ("", pieces[-1][1] + (m["escaped"] or m["plain"]))
        else:
            pieces.append(("", m["escaped"] or m["plain"]))
    return Word(tuple(pieces), "\\" in raw)


def lex(text: str) -> list[tuple[str, Any]]:
    """(kind, value): marks and keywords are their own kind; a phrase has its text, a word its pieces."""
    out: list[tuple[str, Any]] = []
    at = 0
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise invalid("a backslash needs a character behind it" if text[at] == "\\" else "a phrase must end on its line")
        at = m.end()
        if m["mark"]:
            out.append((m["mark"], None))
        elif m["quote"]:
            out.append(("phrase", re.sub(r"\\([\s\S])", r"\1", m["phrase"])))
        elif m["word"]:
            word = _word(m["word"])
            key = word.plain.upper() if word.plain.isascii() and not word.wild and not word.escaped else ""
            out.append((key, None) if key in _KEYWORDS else ("word", word))
    return out


def _joined(kind: str, parts: list[Node]) -> Node:
    return parts[0] if len(parts) == 1 else Node(kind, parts=tuple(parts))


def of_terms(terms: list[str], operator: str) -> Node:
    return _joined(operator, [Node("term", t) for t in terms]) if terms else Node("empty")


@dataclass
class _Group:
    """An open group: its finished alternatives, the finished clauses of the current one, and the run of
    neighbours being read. ``sign``, ``named`` and ``negative`` wait for the next operand or run."""

    operator: str
    alternatives: list[Node] = field(default_factory=list)
    clauses: list[Node] = field(default_factory=list)
    run: list[Node] = field(default_factory=list)
    sign: str = ""
    named: bool = False
    negative: bool = False
    linked: bool = False  # an AND stands before the run

    def add(self, node: Node) -> None:
        if self.sign and node.sign:
            raise invalid("a clause has two signs")
        self.run.append(replace(node, sign=self.sign))
        self.sign, self.named = "", False

    def close(self, keyword: str) -> None:
        """What a keyword, or the end of the group (""), finishes."""
        if keyword == "NOT" and self.linked and not (self.run or self.sign or self.named or self.negative):
            self.negative = True
            return
        if not self.run or self.sign or self.named:
            raise invalid(f"a term is missing before {keyword or 'the end'}")
        clause = _joined(self.operator, self.run)
        if self.negative and clause.sign == "+":
            raise invalid("a clause is both required and prohibited")
        self.clauses.append(replace(clause, sign="-") if self.negative else clause)
        self.run, self.negative, self.linked = [], keyword == "NOT", keyword == "AND"
        if keyword in ("OR", ""):
            self.alternatives.append(_joined("and", self.clauses))
            self.clauses = []


def _number(token: tuple[str, Any] | None, pattern: str) -> float:
    if token is None or token[0] != "word" or token[1].wild or not re.fullmatch(pattern, token[1].plain, re.A):
        raise invalid("~ and ^ need a number")
    return float(token[1].plain)


def _near(node: Node, n: float) -> Node:
    """``node ~ n``: the slop of a phrase, or the distance of one fuzzy term."""
    if node.kind == "phrase" and node.value[1] == 0 and n <= MAX_SLOP:
        return replace(node, value=(node.value[0], int(n)))
    if node.kind == "term" and 1 <= n <= MAX_FUZZY and len(node.value) <= MAX_FUZZY_CHARS:
        return replace(node, kind="match", value=Matcher("fuzzy", node.value, int(n)))
    raise invalid(f"~ takes a phrase and 0 to {MAX_SLOP}, or a term of at most {MAX_FUZZY_CHARS} characters and 1 to {MAX_FUZZY}")


def _boosted(node: Node, b: float) -> Node:
    if not 0 < b <= MAX_BOOST or math.isnan(b):
        raise invalid("a boost is positive and at most 1e6")
    return replace(node, boost=b)


#: What may follow an operand, in this order and once each: the number's form, and what it does.
_SUFFIXES = (("~", r"[0-9]+", _near), ("^", r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", _boosted))


@dataclass
class _Reader:
    """Operands of one query."""

    analyzer: Analyzer
    operator: str

    def _single(self, text: str) -> str:
        terms = self.analyzer.tokens(text)
        if len(terms) != 1:
            raise invalid(f"{text!r} is not one term")
        return terms[0]

    def word(self, word: Word) -> Node:
        if word.anything:
            return Node("all")
        if not word.wild:
            return of_terms(self.analyzer.tokens(word.plain), self.operator)
        source = "".join({"*": ".*", "?": "."}.get(k) or re.sub(r"([^\w])", r"\\\1", self._single(s)) for k, s in word.pieces)
        return Node("match", Matcher("wildcard", f"(?s)^{source}$"))

    def phrase(self, text: str) -> Node:
        terms = self.analyzer.tokens(text)
        return Node("phrase", (tuple(terms), 0)) if len(terms) > 1 else of_terms(terms, "or")

    def interval(self, tokens: list[tuple[str, Any]]) -> Node:
        """Five tokens: bracket, bound, TO, bound, bracket."""
        kinds = [k for k, _ in tokens]
        if len(tokens) < 5 or kinds[2] != "word" or tokens[2][1].plain.upper() != "TO" or kinds[4] not in ("]", "}"):
            raise invalid("a range reads [low TO high], with { or } for an open end")
        ends: list[tuple[str, bool] | None] = []
        for (kind, value), bracket in ((tokens[1], kinds[0]), (tokens[3], kinds[4])):
            if kind == "phrase" or (kind == "word" and not value.wild):
                ends.append((self._single(value if kind == "phrase" else value.plain), bracket in "[]"))
            elif kind == "word" and value.anything:
                ends.append(None)
            else:
                raise invalid("a range's end is one term or *")
        return Node("match", Matcher("range", lower=ends[0], upper=ends[1])) if any(ends) else Node("all")


def _tree(tokens: list[tuple[str, Any]], reader: _Reader, field_name: str) -> Node:
    groups, at = [_Group(reader.operator)], 0
    while at < len(tokens):
        kind, value = tokens[at]
        group, operand, used = groups[-1], None, 1
        if kind in _KEYWORDS:
            group.close(kind)
        elif kind in ("+", "-") and not group.sign and not group.named:
            group.sign = kind
        elif kind == "word" and not group.named and tokens[at + 1 : at + 2] == [(":", None)]:
            if value.wild or value.plain != field_name or at + 2 == len(tokens) or tokens[at + 2][0] not in _STARTS:
                raise invalid(f"{value.plain!r}: is not this query's field with a term, phrase, range or group behind it")
            group.named, used = True, 2
        elif kind == "(":
            groups.append(_Group(reader.operator))
        elif kind == ")" and len(groups) > 1:
            group.close("")
            operand = _joined("or", groups.pop().alternatives)
        elif kind in ("[", "{"):
            operand, used = reader.interval(tokens[at : at + 5]), 5
        elif kind in ("word", "phrase"):
            operand = reader.word(value) if kind == "word" else reader.phrase(value)
        else:
            raise invalid(f"{kind} does not belong there")
        at += used
        if operand is not None:
            for mark, pattern, apply in _SUFFIXES:
                if tokens[at : at + 1] == [(mark, None)]:
                    operand = apply(operand, _number(tokens[at + 1] if at + 1 < len(tokens) else None, pattern))
                    at += 2
            groups[-1].add(operand)
    if len(groups) > 1:
        raise invalid("a parenthesis is not closed")
    groups[0].close("")
    return _joined("or", groups[0].alternatives)


def parse(text: str, analyzer: Analyzer, field_name: str, operator: str = "or") -> Node:
    """The tree of a structured query."""
    tokens = lex(text)
    if not tokens:
        raise invalid("full-text query is empty")
    out = _tree(tokens, _Reader(analyzer, operator), field_name)
    waiting = [Node("and", parts=(out,))]
    while waiting:  # nothing may consist of prohibited clauses alone
        node = waiting.pop()
        if node.parts and all(p.sign == "-" for p in node.parts):
            raise invalid("a query or group needs a positive clause")
        waiting.extend(node.parts)
    return out


def match_terms(text: str, analyzer: Analyzer, operator: str = "or") -> Node:
    """The tree of plain terms joined by the default operator."""
    if not text.strip():
        raise invalid("full-text query is empty")
    return of_terms(analyzer.tokens(text), operator)


def osa_within(a: str, b: str, most: int) -> bool:
    """Whether optimal string alignment (edits, and swaps of neighbours) takes at most ``most`` steps."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            best = min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 1)
            now.append(best)
        before, last = last, now
    return last[-1] <= most

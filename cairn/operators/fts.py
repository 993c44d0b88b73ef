"""BM25 search, from stored postings where there are some, otherwise by a scan.

Without an index, statistics of the query's terms are a single global aggregation, and every row
scores itself from its own token array: no shuffle. Only patterns (wildcard, fuzzy, range), whose terms
are not known beforehand, group the matching tokens by term: each row first keeps those that a pattern may
stand for. An index holds the statistics, a vocabulary and segments of postings in term order, so a search
reads the pages of its terms; texts are analyzed only to check phrases. Both ways give the same scores.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.analysis import Analyzer
from cairn.plans.query_string import Matcher, Node, osa_within

K1, B = 1.2, 0.75
_TOP = 1.7976931348623157e308
#: Of stored indexes; others are not read.
FORM = 2


def vocabulary(df: DataFrame, text: str, analyzer: Analyzer) -> DataFrame:
    """term and df: the number of documents that have it."""
    return df.select(F.explode(F.array_distinct(analyzer.column(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _kept(value: Column) -> Column:
    """One element exploded: Spark then keeps the value instead of computing it again at each use."""
    return F.explode(F.array(value))


def _runs(df: DataFrame, text: str, analyzer: Analyzer, pk: str) -> DataFrame:
    """Key, dl, _t and _at: a document's tokens in order, and where each distinct one begins there. Null texts go."""
    tokens = df.where(F.col(text).isNotNull()).select(pk, _kept(F.sort_array(analyzer.column(F.col(text)))).alias("_t"))
    at = F.filter(F.sequence(F.lit(0), F.size("_t")), lambda i: (i < F.size("_t")) & ((i == 0) | (F.get("_t", i) != F.get("_t", i - 1))))
    return tokens.select(pk, F.size("_t").alias("dl"), "_t", _kept(at).alias("_at"))


def _counts() -> Column:
    """(term, tf) of each distinct token, from _t and _at: what a document says of itself, so nothing is shuffled."""
    end = lambda n: F.coalesce(F.get("_at", n + 1), F.size("_t"))
    return F.transform("_at", lambda i, n: F.struct(F.get("_t", i).alias("term"), (end(n) - i).cast("long").alias("tf")))


def postings(df: DataFrame, text: str, analyzer: Analyzer, pk: str) -> DataFrame:
    """Key, dl, term, tf: the inverted index as a table. Keys must be distinct."""
    return _runs(df, text, analyzer, pk).select(pk, "dl", F.inline(_counts()))


def lengths(df: DataFrame, text: str, analyzer: Analyzer, pk: str) -> DataFrame:
    """Key and dl, the number of tokens, of the documents that have the text."""
    return df.where(F.col(text).isNotNull()).select(pk, F.size(analyzer.column(F.col(text))).alias("dl"))


def _counted(found: DataFrame) -> tuple[int, int]:
    return tuple(found.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


@dataclass(frozen=True)
class TextIndex:
    """Postings (term, key, dl, tf), vocabulary (term, df), lengths (key, dl) of all documents that have the text,
    their number, and that of their tokens."""

    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame
    documents: float
    tokens: float

    @staticmethod
    def build(df: DataFrame, text: str, analyzer: Analyzer, pk: str, folder: str) -> str:
        """Write an index; its facts, for ``read``. Each task writes its documents' postings as one segment in
        term order: no posting is shuffled, a search reads the pages of its terms in each segment, and a term
        that most documents have is dealt out as they are. A row without a term stands for each document."""
        spark = df.sparkSession
        rows = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))), _counts())
        _runs(df, text, analyzer, pk).select(pk, "dl", F.inline(rows)).sortWithinPartitions("term").write.parquet(f"{folder}/segments")
        stored = spark.read.parquet(f"{folder}/segments")
        stored.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{folder}/vocabulary")
        return json.dumps(dict(zip(("documents", "tokens"), _counted(stored.where("term is null")), strict=True)) | {"form": FORM})

    @classmethod
    def read(cls, spark: SparkSession, folder: str, facts: str) -> TextIndex | None:
        """A stored index; None if an earlier version wrote it."""
        known = json.loads(facts)
        if known.get("form") != FORM:
            return None
        rows = spark.read.parquet(f"{folder}/segments")
        return cls(rows.where("term is not null"), spark.read.parquet(f"{folder}/vocabulary"), rows.where("term is null").drop("term", "tf"), float(known["documents"]), float(known["tokens"]))

    def overlaid(self, added: DataFrame, gone: DataFrame, text: str, analyzer: Analyzer, pk: str) -> TextIndex:
        """The index after changes: without the documents whose keys are ``gone``, with those ``added``. Only
        the changes are analyzed, and all statistics stay exact."""
        fresh, taken = postings(added, text, analyzer, pk), self.postings.join(gone, pk, "left_semi")
        counts = lambda p, sign: p.groupBy("term").agg((F.count("*") * sign).alias("df"))
        vocabulary = self.vocabulary.unionByName(counts(fresh, 1)).unionByName(counts(taken, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        new, old = lengths(added, text, analyzer, pk), self.lengths.join(gone, pk, "left_semi")
        (n, plus), (m, minus) = _counted(new), _counted(old)
        kept = lambda df: df.join(gone, pk, "left_anti")
        return TextIndex(kept(self.postings).unionByName(fresh), vocabulary, kept(self.lengths).unionByName(new), self.documents + n - m, self.tokens + plus - minus)


def _needs_all(node: Node) -> bool:
    """Whether documents without any of the query's terms can match."""
    return node.kind == "all" or any(_needs_all(p) for p in node.parts)


def _terms(node: Node) -> set[str]:
    own = {node.value} if node.kind == "term" else set(node.value[0]) if node.kind == "phrase" else set()
    return own.union(*(_terms(p) for p in node.parts))


def _matchers(node: Node) -> list[Matcher]:
    own = [node.value] if node.kind == "match" else []
    return own + [m for p in node.parts for m in _matchers(p)]


def idf(n: Column | float, df: Column) -> Column:
    n = F.lit(n) if isinstance(n, float) else n
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def _weight(tf: Column, dl: Column, idf_: Column, avgdl: float) -> Column:
    norm = F.lit(1.0 - B) + F.lit(B) * dl / F.lit(avgdl) if avgdl else F.lit(1.0)
    return idf_ * tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * norm)


def phrase_in(tokens: Column, terms: tuple[str, ...], slop: int) -> Column:
    """Whether the terms occur in order: from some first term, each next one at its first place after
    the one before, all within the phrase's length and ``slop`` more."""
    rest = F.array(*(F.lit(t) for t in terms[1:]))

    def from_start(start: Column) -> Column:
        end = F.least(start + len(terms) - 1 + slop, F.size(tokens) - 1)

        def step(at: Column, term: Column) -> Column:
            found = F.array_position(F.slice(tokens, at + 1, F.greatest(end - at + 1, F.lit(0))), term).cast("int")
            return F.when(found == 0, F.lit(-1)).otherwise(at + found)

        follow = lambda at, term: F.when(at < 0, F.lit(-1)).otherwise(step(F.greatest(at, F.lit(0)), term))
        return F.aggregate(rest, start + 1, follow) >= 0

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.get(tokens, i) == terms[0])
    return F.exists(starts, from_start)


def _capped(score: Column) -> Column:
    return F.when(score > _TOP, F.lit(_TOP)).otherwise(score)


class _Fold:
    """(matched, score) Columns of a query tree."""

    def __init__(self, tf: dict[str, Column], part: dict[str, Column], found: list[tuple[Column, Column]], phrases: list[Column]) -> None:
        self.tf, self.part, self.found, self.phrases = tf, part, iter(found), iter(phrases)

    def of(self, node: Node) -> tuple[Column, Column]:
        zero, no = F.lit(0.0), F.lit(False)
        if node.kind == "empty":
            return no, zero
        if node.kind == "all":
            matched, score = F.lit(True), F.lit(1.0)
        elif node.kind == "term":
            matched, score = self.tf[node.value] > 0, self.part[node.value]
        elif node.kind == "match":
            matched, score = next(self.found)
        elif node.kind == "phrase":
            terms, _ = node.value
            matched = next(self.phrases)
            score = sum((self.part[t] for t in terms[1:]), self.part[terms[0]])
        else:
            matched, score = self._group(node)
        return matched, F.when(matched, _capped(score * F.lit(node.boost))).otherwise(zero)

    def _group(self, node: Node) -> tuple[Column, Column]:
        parts = [(p.sign, *self.of(p)) for p in node.parts]
        banned, score, must, may = F.lit(False), F.lit(0.0), F.lit(True), F.lit(False)
        strict = node.kind == "and"
        for sign, matched, own in parts:
            if sign == "-":
                banned = banned | matched
                continue
            score = score + own
            if strict or sign == "+":
                must = must & matched
            else:
                may = may | matched
        required = strict or any(s == "+" for s, *_ in parts)
        matched = ~banned & (must if required else may)
        return matched, F.when(matched, score).otherwise(F.lit(0.0))


def _prefix(source: str) -> str:
    """The literal start of a wildcard's regex source."""
    return re.sub(r"\\(.)", r"\1", re.match(r"\(\?s\)\^((?:\w|\\.)*)", source)[1])


def _maybe(matcher: Matcher, term: Column) -> Column:
    """Whether a pattern stands for a term: exactly, but for fuzzy ones only what ``_terms_of`` need look at."""
    if matcher.kind == "wildcard":
        return F.startswith(term, F.lit(_prefix(matcher.pattern))) & term.rlike(matcher.pattern)
    if matcher.kind == "range":
        ends = []
        if matcher.lower:
            ends.append(term >= matcher.lower[0] if matcher.lower[1] else term > matcher.lower[0])
        if matcher.upper:
            ends.append(term <= matcher.upper[0] if matcher.upper[1] else term < matcher.upper[0])
        return reduce(lambda a, b: a & b, ends)
    goal, most = matcher.pattern, matcher.distance
    # A swap of neighbours takes two edits.
    return (F.abs(F.length(term) - len(goal)) <= most) & (F.levenshtein(term, F.lit(goal), 2 * most) >= 0)


def _terms_of(matcher: Matcher, vocab: DataFrame) -> DataFrame:
    found = vocab.where(_maybe(matcher, F.col("term")))
    if matcher.kind != "fuzzy":
        return found
    goal, most = matcher.pattern, matcher.distance

    def near(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: osa_within(goal, t, most))

    near.__annotations__ = {"terms": pd.Series, "return": pd.Series}
    return found.where(F.pandas_udf(near, "boolean")(F.col("term")))


def search(corpus: DataFrame, rows: DataFrame, text: str, query: Node, analyzer: Analyzer, pk: str, index: TextIndex | None = None) -> DataFrame:
    """Key and ``_score`` of the ``rows`` that match. Statistics are those of ``corpus`` (whatever the filter that
    gave ``rows``), over documents that have the text. Rows with a score of 0 or less are dropped. ``index``
    must be one of ``corpus``. Keys must be distinct."""
    terms, matchers = sorted(_terms(query)), _matchers(query)
    if index is not None and not _needs_all(query):
        return _searched(index, rows if rows is not corpus else None, corpus, text, query, analyzer, pk, terms, matchers)
    held = _analyzed(corpus, text, analyzer, pk)
    facts = held.agg(F.count("*"), F.coalesce(F.sum(F.size("_t")), F.lit(0)), *(F.coalesce(F.sum(F.array_contains("_t", t).cast("long")), F.lit(0)) for t in terms)).first()
    n, avgdl = float(facts[0]), float(facts[1]) / facts[0] if facts[0] else 0.0
    equal = lambda t: lambda x: x == t
    tf = [F.size(F.filter("_t", equal(t))).cast("double").alias(f"_tf{i}") for i, t in enumerate(terms)]
    phrases = [phrase_in(F.col("_t"), *p.value).alias(f"_p{i}") for i, p in enumerate(_phrases(query))]
    own = [pk, F.size("_t").cast("double").alias("_dl"), *tf, *phrases]
    tokens = _analyzed(rows, text, analyzer, pk)
    if not matchers:
        return _folded(tokens.select(*own), query, terms, [float(x) for x in facts[2:]], n, avgdl, pk)
    # A row's tokens that the patterns may stand for, before anything is shuffled; a row without a pattern stands for all others.
    hits = F.concat(*(F.transform(F.filter("_t", partial(_maybe, m)), partial(_marked, i)) for i, m in enumerate(matchers)))
    dfs = held.select(F.explode(F.array_distinct(hits)).alias("_h")).select("_h.*").groupBy("_m", "term").agg(F.count("*").alias("df"))
    dfs = reduce(DataFrame.unionByName, (_terms_of(m, dfs.where(F.col("_m") == i)) for i, m in enumerate(matchers))) if any(m.kind == "fuzzy" for m in matchers) else dfs
    none = F.array(F.struct(F.lit(-1).alias("_m"), F.lit(None).cast("string").alias("term")))
    rest = [f"_tf{i}" for i in range(len(tf))] + [f"_p{i}" for i in range(len(phrases))]
    each = tokens.select(*own, F.explode(F.concat(none, hits)).alias("_h")).select(pk, "_dl", *rest, "_h.*")
    each = each.groupBy(pk, "_m", "term").agg(F.count("*").cast("double").alias("tf"), *(F.first(c).alias(c) for c in ("_dl", *rest)))
    scored = each.join(dfs, ["_m", "term"], "left").groupBy(pk).agg(*(F.first(c).alias(c) for c in ("_dl", *rest)), *_pattern_sums(len(matchers), F.col("_dl"), n, avgdl))
    return _folded(scored, query, terms, [float(x) for x in facts[2:]], n, avgdl, pk)


def _analyzed(df: DataFrame, text: str, analyzer: Analyzer, pk: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(pk, _kept(analyzer.column(F.col(text))).alias("_t"))


def _marked(i: int, term: Column) -> Column:
    return F.struct(F.lit(i).alias("_m"), term.alias("term"))


def _pattern_sums(n_matchers: int, dl: Column, n: float, avgdl: float) -> list[Column]:
    """_m<i>: a document's score for each pattern, from rows (_m, tf, df); null where it has none of its terms."""
    weight = _weight(F.col("tf"), dl, idf(n, F.col("df").cast("double")), avgdl)
    return [F.sum(F.when(F.col("_m") == i, weight)).alias(f"_m{i}") for i in range(n_matchers)]


#: A term list of so many entries at most is asked for by value; keys of so many documents at most are sent to all tasks.
_FEW_TERMS, _FEW_KEYS = 1000, 100_000


def _searched(index: TextIndex, rows: DataFrame | None, corpus: DataFrame, text: str, query: Node, analyzer: Analyzer, pk: str, terms: list[str], matchers: list[Matcher]) -> DataFrame:
    """The same from postings: every document that has one of the terms, and its frequencies. ``rows`` is None for
    the whole corpus. Texts are read for phrases alone."""
    known = {r["term"]: float(r["df"]) for r in index.vocabulary.where(F.col("term").isin(terms)).collect()} if terms else {}
    n, avgdl = index.documents, index.tokens / index.documents if index.documents else 0.0
    parts = [index.postings.where(F.col("term").isin(terms)).select(pk, "dl", "term", "tf", F.lit(-1).alias("_m"), F.lit(None).cast("long").alias("df"))] if terms else []
    for i, matcher in enumerate(matchers):
        # Only postings that may be the pattern's meet its terms.
        hits = _terms_of(matcher, index.vocabulary)
        few = [r["term"] for r in hits.select("term").limit(_FEW_TERMS + 1).collect()]
        near = F.col("term").isin(few) if len(few) <= _FEW_TERMS else _maybe(matcher, F.col("term"))
        parts.append(index.postings.where(near).join(hits, "term").select(pk, "dl", "term", "tf", F.lit(i).alias("_m"), "df"))
    tf = [F.max(F.when((F.col("_m") == -1) & (F.col("term") == t), F.col("tf")).otherwise(0)).cast("double").alias(f"_tf{i}") for i, t in enumerate(terms)]
    each = reduce(DataFrame.unionByName, parts)
    found = each.groupBy(pk).agg(F.first("dl").cast("double").alias("_dl"), *tf, *_pattern_sums(len(matchers), F.col("dl").cast("double"), n, avgdl))
    if rows is not None:
        found = found.join(rows.where(F.col(text).isNotNull()).select(pk), pk, "left_semi")
    if phrases := _phrases(query):
        flags = [f"_p{i}" for i in range(len(phrases))]
        own = [reduce(lambda a, b: a & b, (F.col(f"_tf{terms.index(t)}") > 0 for t in p.value[0])) for p in phrases]
        texts = rows if rows is not None else corpus
        # At most as many documents as have the rarest term of each phrase. If those are many, all texts are looked at where
        # they lie, which takes no shuffle of texts.
        if sum(min(known.get(t, 0.0) for t in p.value[0]) for p in phrases) <= _FEW_KEYS:
            texts = texts.join(F.broadcast(found.where(reduce(lambda a, b: a | b, own)).select(pk)), pk, "left_semi")
        held = _analyzed(texts, text, analyzer, pk).select(pk, *(phrase_in(F.col("_t"), *p.value).alias(c) for c, p in zip(flags, phrases, strict=True)))
        found = found.join(held.where(reduce(lambda a, b: a | b, map(F.col, flags))), pk, "left").fillna(False, flags)
    return _folded(found, query, terms, [known.get(t, 0.0) for t in terms], n, avgdl, pk)


def _nodes(node: Node) -> list[Node]:
    return [node, *(x for p in node.parts for x in _nodes(p))]


def _phrases(node: Node) -> list[Node]:
    return [x for x in _nodes(node) if x.kind == "phrase"]


def _folded(scored: DataFrame, query: Node, terms: list[str], dfs: list[float], n: float, avgdl: float, pk: str) -> DataFrame:
    """Rows with lengths (_dl), term frequencies (_tf<i>), pattern scores (_m<i>) and phrases (_p<i>) to the keys of
    those that match, with ``_score``."""
    tf = {t: F.col(f"_tf{i}") for i, t in enumerate(terms)}
    part = {t: _weight(tf[t], F.col("_dl"), F.lit(math.log((n - d + 0.5) / (d + 0.5) + 1.0)), avgdl) for t, d in zip(terms, dfs, strict=True)}
    found = [(F.col(m).isNotNull(), F.coalesce(m, F.lit(0.0))) for m in (f"_m{i}" for i in range(len(_matchers(query))))]
    matched, score = _Fold(tf, part, found, [F.col(f"_p{i}") for i in range(len(_phrases(query)))]).of(query)
    return scored.withColumn("_score", score).where(matched & (F.col("_score") > 0)).select(pk, "_score")

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. A text's features are its distinct words, word stems, word pairs and pairs with one word
between, hashed to ``BITS`` bits. A feature's value is its smoothed log count ratio between toxic and
other texts, and features of fewer than ``LEAST_TEXTS`` learning texts are left out. FTRL-proximal
learns their weights with a rate per coordinate and L1, which leaves most at exactly zero; the others
(at most 2**BITS, a fixed bound) travel with the scoring tasks. Learning uses at most ``max_rows`` labelled rows, those with the smallest hash of their id;
scoring covers all words of all texts and needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ARROW_ROWS, lean, small_batches
from cairn.llm.sentencepiece_codec import _one, stretches

BITS = 22
#: Labelled rows that learning uses at most.
MAX_ROWS = 20_000
EPOCHS = 5
#: Learning texts that must have a feature.
LEAST_TEXTS = 2
#: Characters of a word's stem: inflected forms of a word share it.
STEM = 4
#: Score from which a text counts as toxic.
CUT = 0.3
# FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.0, 0.1

_NOT_WORD = r"[^\p{L}\p{N}]+"
_MASK = np.uint64((1 << BITS) - 1)


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """A hash of two word hashes and a feature kind, to BITS bits."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(kind * 0x165667B19E3779F9 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) & _MASK).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of every word, pair and skip pair, repeats included. Null has none."""
    plain = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    cut = pc.split_pattern_regex(plain, _NOT_WORD)
    coded = cut.values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.array([zlib.crc32(w.encode()) | 1 << 32 if w else 0 for w in distinct], np.uint64)
    stems = np.array([zlib.crc32(w[:STEM].encode()) for w in distinct], np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
    at, of = (x[hashes[at] > 0] if len(at) else x for x in (at, of))
    word = hashes[at] if len(at) else np.empty(0, np.uint64)
    stem = stems[at] if len(at) else word
    rows, found = [of, of], [_mixed(word, np.zeros_like(word), 1), _mixed(stem, np.zeros_like(stem), 4)]
    for kind, step in ((2, 1), (3, 2)):
        same = of[:-step] == of[step:]
        rows.append(of[:-step][same])
        found.append(_mixed(word[:-step][same], word[step:][same], kind))
    return np.concatenate(rows), np.concatenate(found)


def _distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << BITS | found)
    return both >> BITS, both & ((1 << BITS) - 1)


def count_ratios(examples: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Each feature's smoothed log count ratio; 0 for those of too few texts."""

    def counts(label: int) -> np.ndarray:
        out = np.zeros(1 << BITS, np.int32)
        for e, y in zip(examples, labels, strict=True):
            if y == label:
                out[e] += 1  # an example's features are distinct
        return out

    toxic, other = counts(1), counts(0)
    ratio = np.log((toxic + 1) / ((labels == 1).sum() + 2)) - np.log((other + 1) / ((labels == 0).sum() + 2))
    return np.where(toxic + other >= LEAST_TEXTS, ratio, 0.0)


def learn(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the examples in the order given: (features, weights other than 0, bias)."""
    ratio = count_ratios(examples, labels)
    known = np.flatnonzero(ratio)
    bias = len(known)
    # Each example's known features, by their places among all known ones, and the bias.
    examples = [np.append(np.searchsorted(known, e[ratio[e] != 0]), bias).astype(np.int32) for e in examples]
    value = np.append(ratio[known], 1.0)
    del ratio
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at == bias, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, label in zip(examples, labels, strict=True):
            w, x = weight(at), value[at]
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    used = np.flatnonzero(np.abs(z[:-1]) > L1)
    return known[used], weight(used) * value[used], float(weight(np.array([bias]))[0])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in stretches(batches, 2):
        of, found = _distinct(*features(_one(rows.column(2))))
        ends = np.searchsorted(of, np.arange(len(rows) + 1))
        packed = [found[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([_one(rows.column(0)), _one(rows.column(1)), pa.array(packed, pa.binary())], ["turn", "label", "found"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[1], r[2]))
    at, w, bias = learn([np.frombuffer(r[2], "<i4") for r in rows], np.array([r[1] for r in rows], float))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS), pa.int64()), pa.array(np.append(w, bias), pa.float64())], ["feature", "weight"])


class Model:
    """Weights by feature, in feature order, and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias

    @cached_property
    def _table(self) -> np.ndarray:
        """All weights by feature, built once in each task; only the sparse form travels."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.features] = self.weights
        return table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def scores(self, texts: pa.Array) -> np.ndarray:
        table = self._table
        of, found = features(texts)
        hit = table[found] != 0
        of, found = _distinct(of[hit], found[hit])
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + np.bincount(of, table[found], len(texts)), -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learn ``labels.toxic`` from the whole texts of the chosen rows. Rows with a null label or id
    are left out; without any row, every score is 0.5."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("turn"), F.col("toxic").cast("int").alias("label")).orderBy("turn", "label").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("turn", "label", "text")
    packed = rows.mapInArrow(lean(_features_of), "turn long, label int, found binary")
    # Learning is sequential and its input bounded: one task.
    found = packed.repartition(1).mapInArrow(lean(_learned), "feature long, weight double").collect()  # at most 2**BITS + 1 rows
    at = np.array([r[0] for r in found], np.int64)
    w = np.array([r[1] for r in found], float)
    inner = at < 1 << BITS
    return Model(at[inner], w[inner], float(w[~inner].sum()))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, 1):
            yield pa.RecordBatch.from_arrays([_one(rows.column(0)), pa.array(model.scores(_one(rows.column(1))), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; empty and null texts get the bias alone.
    Repeated rows give repeated rows, null ids stay null, an empty table gives no rows."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scorer(model)), "doc_id long, score double")


def _keeper(model: Model, at: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, at):
            kept = rows.filter(pa.array(model.scores(_one(rows.column(at))) < cut))
            yield from kept.to_batches(max_chunksize=ARROW_ROWS)

    return run


def drop_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, whose score is below ``cut``.
    Repeated rows share a score, so all of them stay or go; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(_keeper(model, docs.columns.index("text"), cut)), docs.schema)

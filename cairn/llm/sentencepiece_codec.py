"""SentencePiece encoding and decoding with a distinct-chunk table.

Method. When no piece of the model has a white-space marker after another character, no merge can
cross the start of a marked word, so a text's ids are the ids of its marked words in order. A task
cuts texts at those starts, segments every distinct marked word once, keeps its ids in a table and
joins them back by position. The table lives in the task (a word's ids are the same everywhere), so
the corpus is never shuffled; it holds at most ``table_chars`` characters and starts anew when full,
which changes the work but never the ids. A model that fails the test above, or normalises text in
any other way than by marking spaces, is applied to whole texts instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lean, small_batches

MARK = "▁"
#: Characters that a task's table may hold before it starts anew.
TABLE_CHARS = 3 << 20
#: Bytes of text that a task cuts and joins at a time.
STRETCH = 1 << 20


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def splits_at_marks(path: str) -> bool:
    """Whether texts can be cut before each run of spaces: no piece has a marker after another
    character, spaces are kept and marked, one is put in front, and nothing else is rewritten."""
    m = _model(path)
    if any(re.search(f"[^{MARK}]{MARK}", m.id_to_piece(i)) for i in range(m.vocab_size())):
        return False
    probe = "  a ﬁ ééＡ​\t b ① "
    return m.normalize(probe) == MARK + probe.replace(" ", MARK)


#: Texts for which the plain cut at single spaces is not a cut before whole runs of markers.
_RUNS = f"^ | $|  |{MARK}"
#: A marked word: its markers, then everything up to the next one.
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Segmenter:
    """The table of one task: distinct marked words and, end to end, their ids."""

    def __init__(self, path: str, table_chars: int = TABLE_CHARS) -> None:
        self._m, self._room, self._whole = _model(path), table_chars, not splits_at_marks(path)
        self._clear()

    def _clear(self) -> None:
        self._row: dict[str, int] = {}
        self._used, self._ids, self._ends = 0, np.empty(0, np.int32), np.zeros(1, np.int64)

    def _rows(self, distinct: list[str]) -> np.ndarray:
        """The table rows of these words; the words that it lacks are segmented now."""
        if self._used > self._room:
            self._clear()
        row = self._row
        if new := [w for w in distinct if w not in row]:
            ids = self._m.encode(new, num_threads=1)
            row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
            self._ids = np.concatenate([self._ids, np.fromiter((i for x in ids for i in x), np.int32)])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(x) for x in ids])])
            self._used += sum(map(len, new))
        return np.fromiter(map(row.__getitem__, distinct), np.int64, len(distinct))

    def _by_runs(self, text: str) -> list[int]:
        """A text with runs of spaces or literal markers, cut before each run."""
        ids: list[int] = []
        for chunk in _CHUNK.findall(MARK + text.replace(" ", MARK)):
            # The library puts one marker in front of any text: a chunk gives up its own first one.
            ids += self._m.encode(chunk[1:]) if len(chunk) > 1 else [self._m.piece_to_id(MARK)]
        return ids

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """ids of each text; null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self._whole:
            return pa.array(self._m.encode(texts.to_pylist(), num_threads=1), pa.large_list(pa.int32()))
        odd = pc.match_substring_regex(texts, _RUNS)
        plain = pc.if_else(odd, "", texts)
        cut = pc.split_pattern(plain, " ")
        coded = cut.values.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        first, size = self._ends[rows], np.diff(self._ends)[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        out = pa.LargeListArray.from_arrays(pa.array(ends[cut.offsets.to_numpy()]), pa.array(ids, pa.int32()))
        if not pc.any(odd).as_py():
            return out
        rest = [self._by_runs(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        both = pa.concat_arrays([out, pa.array([x or [] for x in rest], pa.large_list(pa.int32()))])
        at = np.arange(len(out))
        return both.take(pa.array(np.where(odd.to_numpy(zero_copy_only=False), at + len(out), at)))


def stretches(batches: Iterator[pa.RecordBatch], column: int, most: int = STRETCH) -> Iterator[pa.Table]:
    """The same rows, in tables of about ``most`` bytes of the given column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _encoder(path: str, table_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(path, table_chars)
        for rows in stretches(batches, 1):
            ids = segmenter.encode(_one(rows.column(1))).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([_one(rows.column(0)), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str, table_chars: int = TABLE_CHARS) -> DataFrame:
    """doc_id and ids (array<int>) of every row's whole text, as the library encodes it without
    begin and end ids. Null and empty texts have no ids; repeated rows give repeated rows."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_encoder(model, table_chars)), "doc_id long, ids array<int>")


@lru_cache(maxsize=2)
def _surfaces(path: str) -> pa.Array:
    """What each id adds to a text, as bytes; null for ids that only the library decodes."""
    m = _model(path)

    def surface(i: int) -> bytes | None:
        if m.is_byte(i):
            return bytes([int(m.id_to_piece(i)[3:5], 16)])
        return None if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else m.id_to_piece(i).replace(MARK, " ").encode()

    return pa.array([surface(i) for i in range(m.vocab_size())], pa.binary())


@lru_cache(maxsize=2)
def _space_byte(path: str) -> int:
    """The id of a space as a byte, which the library does not take for the marker in front."""
    return _model(path).piece_to_id("<0x20>")


def decode_ids(path: str, ids: pa.ListArray) -> pa.Array:
    """decode(ids) of each list: the joined surfaces without the first space; lists whose bytes are
    not UTF-8 or that hold other ids go through the library."""
    m = _model(path)
    if not splits_at_marks(path):
        return pa.array(m.decode([x or [] for x in ids.to_pylist()], num_threads=1), pa.string())
    try:
        pieces = _surfaces(path).take(ids.flatten())
        if pieces.null_count:
            raise ValueError("ids for the library")
        lists = pa.ListArray.from_arrays(pc.cast(pc.subtract(ids.offsets, ids.offsets[0]), pa.int32()), pieces)
        joined = pc.binary_join(lists, b"").cast(pa.string())
        starts = np.minimum(lists.offsets.to_numpy()[:-1], max(len(pieces) - 1, 0))
        marked = pc.not_equal(ids.flatten().take(pa.array(starts)), _space_byte(path)) if len(pieces) else pa.scalar(False)
        return pc.fill_null(pc.if_else(pc.and_(pc.starts_with(joined, " "), marked), pc.utf8_slice_codeunits(joined, 1), joined), "")
    except (ValueError, pa.ArrowException):
        return pa.array(m.decode([x or [] for x in ids.to_pylist()], num_threads=1), pa.string())


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, 1):
            ids = _one(rows.column(1))
            yield pa.RecordBatch.from_arrays([_one(rows.column(0)), ids, decode_ids(path, ids)], ["doc_id", "ids", "decoded"])

    return run


def _round_trip(path: str, table_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(path, table_chars)
        for rows in stretches(batches, 1):
            ids = segmenter.encode(_one(rows.column(1))).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([_one(rows.column(0)), ids, decode_ids(path, ids)], ["doc_id", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, model: str, table_chars: int = TABLE_CHARS) -> DataFrame:
    """doc_id, ids and decoded of every row: ``decode(encode(docs))`` in one pass, so that a task has one
    Python worker and ids are not sent twice. Null and empty texts have no ids and decode to the empty
    text; repeated rows give repeated rows; an empty table gives none; other columns are ignored."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_round_trip(model, table_chars)), "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the library's decode(ids) gives, as ``decoded``.
    Null ids decode to the empty text."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(lean(_decoder(model)), "doc_id long, ids array<int>, decoded string")

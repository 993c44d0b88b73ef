"""Substring deduplication by hashing units of text.

Method. Texts are tiled into units: clauses (pieces of a line that end in punctuation and have
``UNIT_WORDS`` words or more), whole lines, or paragraphs between blank lines. A unit of ``UNIT_WORDS``
different words or more (one word over and over is no passage) is normalised (case, white space, outer punctuation) and hashed to 128 bits. Digests are
grouped over the whole corpus; the occurrence with the smallest rank (doc_id, then place) stays. Later
occurrences go where adjacent ones add up to a passage of ``MIN_WORDS`` words, so a passage is found
wherever its lines are broken and whatever stands around it, and a short stock phrase stays. What a
document repeats of itself goes only where one unit is that long. Groups
are combined before they meet and dealt back under salts, so a unit that a third of all documents hold
is never gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dealt_back, lean, salt_of, saved, small_batches

#: Words from which a passage is worth removing, and a unit worth hashing.
MIN_WORDS, UNIT_WORDS = 20, 3
SALTS = 32

#: White space within a line, a word's characters, and what ends a clause.
_GAP, _CHAR, _STOP = r"[\x20\x09\x0B-\x0D]", r"[^\x20\x09-\x0D]", r"[.!?,;:]"
_LINE = r"[^\n]*\n|[^\n]+"
#: Tiles: every text is the concatenation of its matches. A clause is the shortest of its words.
TILES = {
    "clause": rf"{_GAP}*{_CHAR}+(?:{_GAP}+{_CHAR}+){{{UNIT_WORDS - 2},}}?{_GAP}+{_CHAR}*{_STOP}(?:{_GAP}+\n?|\n|\z)|{_LINE}",
    "line": _LINE,
    "paragraph": r"(?:[^\n]*[^\x20\x09-\x0D][^\n]*(?:\n|\z))+|[\x20\x09-\x0D]+",
}
_TILE = {kind: re.compile(pattern.replace(r"\z", r"\Z")) for kind, pattern in TILES.items()}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_OUTER = ".,;:!?-*#|\"'() "
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_NO_ID = (1 << 63) - 1
_UNITS = "_id long, _th long, unit int, start int, end int, words int, again boolean, high long, low long"
_LATER = "array<struct<unit:int,start:int,end:int,words:int,keep_id:long>>"
_REMOVED = "array<struct<start:int,end:int,keep_id:long>>"


def tiles(text: str, kind: str = "clause") -> list[tuple[int, int]]:
    """(start, end) of a text's tiles, with the white space around each unit."""
    return [m.span() for m in _TILE[kind].finditer(text) if m.end() > m.start()]


def units(text: str, kind: str = "clause") -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of a text's units of ``UNIT_WORDS`` different words or more, without the white
    space around them."""
    for a, b in tiles(text, kind):
        tile = text[a:b]
        words = [w for w in _SPACE.split(tile.lower()) if w]
        if len(set(words)) >= UNIT_WORDS and (plain := " ".join(words).strip(_OUTER)):
            start = a + len(tile) - len(tile.lstrip(_WHITE))
            yield start, a + len(tile.rstrip(_WHITE)), len(words), blake2b(plain.encode(), digest_size=16).digest()


def _hashed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met: set[bytes] = set()
                for n, (start, end, words, d) in enumerate(units(text, kind)):
                    rows.append((i, th, n, start, end, words, d in met, int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)))
                    met.add(d)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in _UNITS.split(", ")])

    return run


def _identity(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_th": F.xxhash64(F.coalesce("text", F.lit("")))})


def repeated_units(docs: DataFrame, kind: str = "clause", min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th, later: each document's later occurrences (unit, start, end, words, keep_id), in order."""
    small_batches(docs.sparkSession)
    # Rows that repeat id and text are one document; equal rows of units fold into one.
    hashed = _identity(docs).select("_id", "_th", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(_hashed(kind)), _UNITS)
    found = saved(hashed, "units").withColumn("salt", salt_of(F.struct("_id", "_th"), SALTS))
    # Numbers only, so that groups combine in hash maps before the shuffle; salts in use are a mask.
    salts = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt")))
    groups = found.groupBy("high", "low").agg(F.min("_id").alias("keep_id"), F.count("*").alias("n"), salts.alias("salts")).where("n > 1")
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    met = saved(found.join(groups.select("high", "low", "keep_id", F.explode(used).alias("salt")), ["high", "low", "salt"]), "met")
    # Of documents with the smallest id (one, unless ids repeat) the one whose text hash is smallest comes first.
    tied = met.where(~F.col("again") & (F.col("_id") == F.col("keep_id")))
    first = dealt_back(tied, ["high", "low"], {"least": F.min("_th"), "most": F.max("_th")}, {"least": F.min("least"), "most": F.max("most")}).where("least <> most")
    second = tied.join(first, ["high", "low", "salt"]).where(F.col("_th") != F.col("least"))
    # A unit first met in the same document is later there only if it is a passage by itself.
    later = met.where((F.col("again") & (F.col("words") >= min_words)) | (F.col("_id") != F.col("keep_id"))).unionByName(second.select(*met.columns))
    return later.groupBy("_id", "_th").agg(F.sort_array(F.collect_set(F.struct("unit", "start", "end", "words", "keep_id"))).alias("later"))


def passages(later: list[dict], min_words: int = MIN_WORDS) -> list[dict]:
    """Those of a document's later occurrences that stand in a run of adjacent ones with ``min_words`` words."""
    out, run = [], []
    for x in [*later, None]:
        if run and (x is None or x["unit"] != run[-1]["unit"] + 1):
            if sum(r["words"] for r in run) >= min_words:
                out += run
            run = []
        run.append(x)
    return out


def without(text: str, starts: set[int], kind: str = "clause") -> str:
    """The text without the tiles of the units that start there. A line break goes with its line only: a
    line of which something stays keeps it."""
    parts, line, kept = [], [], False
    for a, b in tiles(text, kind):
        tile = text[a:b]
        if a + len(tile) - len(tile.lstrip(_WHITE)) not in starts:
            line.append(tile)
            kept = True
        elif tile.endswith("\n"):
            line.append("\n")
        if tile.endswith("\n"):
            parts += line if kept else []
            line, kept = [], False
    return "".join([*parts, *(line if kept else [])])


def _cutter(kind: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, later in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = passages(later, min_words) if later else []
                texts.append(without(text, {g["start"] for g in gone}, kind) if gone else text)
                removed.append([{k: g[k] for k in ("start", "end", "keep_id")} for g in gone])
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("keep_id", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), spans], ["doc_id", "text", "removed"])

    return run


def dedup_units(docs: DataFrame, kind: str = "clause", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the removed units and, where all of a line goes, its line break) and removed,
    an array of (start, end, keep_id) with offsets in code points of the original text.

    Null texts stay null and have no units; a null id ranks last, documents of one id by text hash; of
    repeated rows (same id and text) all keep the same units. What repeats only inside one text (or texts
    of one id) goes where a single unit has ``min_words`` words: a refrain of short lines stays. An empty table gives no rows; other columns are not returned.
    """
    rows = _identity(docs).join(repeated_units(docs, kind, min_words), ["_id", "_th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("later", F.array().cast(_LATER)).alias("later"))
    return rows.mapInArrow(lean(_cutter(kind, min_words)), f"doc_id long, text string, removed {_REMOVED}")

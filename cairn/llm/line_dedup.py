"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

Method. A document is the sequence of hashes of its non-blank lines. A window starts at every line
and reaches over the fewest lines with ``WINDOW`` words; it selects its line with the smallest hash.
The gram at a selected line (the fewest lines from it with ``GRAM`` words) is a fingerprint of 128 bits. A
run of lines with ``WINDOW + GRAM`` words that two documents share holds a whole window and the gram at its
selected line, and so does a single line of ``GRAM`` words: both documents have that fingerprint.
Every occurrence of a fingerprint is joined to the one before it (by doc_id, then line; within its salt) and
the first in a document also to the earliest of all, so no group's pairs are ever made and a text that
repeats one line has one diagonal. The match is extended both ways over equal lines, and the later
document's lines go.

Grams of a run overlap, as selected lines are less than ``WINDOW`` words apart; only lines before the first
(fewer than ``WINDOW`` words) and behind the last one (fewer than ``WINDOW + GRAM``) can be missed by all of
them. An occurrence carries those neighbours, so extending needs no other line of either document, and
the work is in proportion to the number of lines.

Every deleted line has an equal line earlier, so by induction its first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_RUN, WORD, dealt_back, packed, salt_of, saved, unpacked

#: Words of a window, and of a gram, the shortest run that is deleted.
WINDOW, GRAM = 10, 20
#: Salts of a fingerprint's occurrences.
SALTS = 32

_NO_ID = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> DataFrame:
    """``docs`` packed, with its rows' text and identity: _id (a null id comes last) and _th, a hash of
    the text. Rows that agree in both are one document."""
    text = F.col("_row.text")
    return packed(docs).select("_row", text.alias("text"), F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"))


def sequences(docs: DataFrame) -> DataFrame:
    """_id, _th, lines: of each document's non-blank lines two hashes (h, g) and the words (w)."""

    def line(x: Column) -> Column:
        plain = F.transform(F.array(F.lower(F.trim(F.regexp_replace(x, SPACE_RUN, " ")))), lambda p: F.struct(F.xxhash64(p).alias("h"), F.xxhash64(F.lit(1), p).alias("g")))
        return F.struct(plain[0]["h"].alias("h"), plain[0]["g"].alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w"))

    return _identity(docs).select("_id", "_th", F.filter(F.transform(_lines(F.col("text")), line), lambda x: x["w"] > 0).alias("lines"))


def _while(lines: Column, words: int) -> Column:
    """The hashes of the first of these lines, as far as they have fewer than ``words`` words together."""
    step = lambda acc, x: F.struct((acc["w"] + x["w"]).alias("w"), (acc["n"] + (acc["w"] + x["w"] < words).cast("int")).alias("n"))
    n = F.aggregate(lines, F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return F.transform(F.slice(lines, 1, n), lambda x: x["h"])


def _grams(window: int, gram: int) -> Column:
    """Fingerprints of ``lines``: first line (p, from 0), number of lines (n), hashes (a, b), and the hashes
    of the lines before (nearest first) and behind."""
    # A line has a word at least, so as many lines as words always suffice.
    ahead = lambda i, n: F.slice("lines", i + 1, n)

    def least(acc: Column, x: Column) -> Column:
        open_, better = acc["w"] < window, x["h"] <= acc["h"]
        take = open_ & (better | (acc["n"] == 0))
        return F.struct(F.when(open_, acc["w"] + x["w"]).otherwise(acc["w"]).alias("w"), (acc["n"] + 1).alias("n"), F.when(take, x["h"]).otherwise(acc["h"]).alias("h"), F.when(take, acc["n"]).otherwise(acc["k"]).alias("k"))

    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("k"))
    selected = F.array_distinct(F.transform("lines", lambda _, i: i + F.aggregate(ahead(i, window), zero, least, lambda a: a["k"])))

    def joined(acc: Column, x: Column) -> Column:
        open_ = acc["w"] < gram
        more = lambda h, y: F.when(open_, F.xxhash64(acc[h], x[y])).otherwise(acc[h]).alias(h)
        return F.struct(F.when(open_, acc["w"] + x["w"]).otherwise(acc["w"]).alias("w"), (acc["n"] + open_.cast("int")).alias("n"), more("a", "h"), more("b", "g"))

    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    found = F.transform(selected, lambda p: F.struct(p.alias("p"), F.aggregate(ahead(p, gram), start, joined).alias("x")))
    found = F.filter(found, lambda f: f["x"]["w"] >= gram)
    first = lambda p: F.greatest(p - (window - 1), F.lit(0))
    before = lambda p: _while(F.reverse(F.slice("lines", first(p) + 1, p - first(p))), window)
    behind = lambda p, n: _while(F.slice("lines", p + n + 1, window + gram - 1), window + gram)
    return F.transform(found, lambda f: F.struct(f["p"].alias("p"), f["x"]["n"].alias("n"), f["x"]["a"].alias("a"), f["x"]["b"].alias("b"), before(f["p"]).alias("before"), behind(f["p"], f["x"]["n"]).alias("behind")))


def _alike(x: Column, y: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    step = lambda acc, same: F.struct((acc["open"] & same).alias("open"), (acc["n"] + (acc["open"] & same).cast("int")).alias("n"))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def repeated_lines(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_id, _th, removed: the numbers (from 0) of each document's non-blank lines to delete."""
    lines = sequences(docs)
    found = lines.select("_id", "_th", F.explode(_grams(window, gram)).alias("g")).select("_id", "_th", "g.*")
    found = saved(found, "grams").withColumn("salt", salt_of(F.struct("_id", "_th"), SALTS))
    # Fingerprints met more than once, counted in hash maps before the shuffle; salts in use are a mask.
    salts = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt")))
    often = found.groupBy("a", "b").agg(F.count("*").alias("times"), salts.alias("salts")).where("times > 1")
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    met = found.join(often.select("a", "b", F.explode(used).alias("salt")), ["a", "b", "salt"])
    met = saved(met.dropDuplicates(["_id", "_th", "p"]), "met")
    one = F.struct("_id", "_th", "p", "before", "behind")
    earliest = dealt_back(met, ["a", "b"], {"first": F.min(one)}, {"first": F.min("first")})
    previous = F.lag(one).over(Window.partitionBy("a", "b", "salt").orderBy("_id", "_th", "p"))
    same = lambda x, *names: F.coalesce(F.forall(F.array(*(F.col(f"{x}.{k}") == F.col(k) for k in names)), lambda e: e), F.lit(False))
    pairs = met.withColumn("previous", previous).join(earliest, ["a", "b", "salt"])
    # The first occurrence of a document also meets the earliest one of all; that one itself meets none.
    pairs = pairs.withColumn("others", F.array_compact(F.array("previous", F.when(~same("previous", "_id", "_th") & ~same("first", "_id", "_th", "p"), F.col("first")))))
    match = pairs.select("_id", "_th", "p", "n", "before", "behind", F.explode("others").alias("o"))
    spans = match.select("_id", "_th", (F.col("p") - _alike(F.col("before"), F.col("o.before"))).alias("lo"), (F.col("p") + F.col("n") + _alike(F.col("behind"), F.col("o.behind"))).alias("hi"))
    each = F.transform(F.collect_set(F.struct("lo", "hi")), lambda s: F.sequence(s["lo"], s["hi"] - 1))
    return spans.groupBy("_id", "_th").agg(F.sort_array(F.array_distinct(F.flatten(each))).alias("removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with text (later repeated runs of lines deleted), n_chars (where there is one) its new
    length, and n_removed, the number of lines deleted (in place of a column of that name).

    Lines are compared without case and with white space as one space; blank lines stay and don't
    break a run. Null texts stay null, untouched texts stay as they are; a text may become empty. Of
    equal lines the one in the smallest doc_id stays (null last; rows of one id by text hash); rows
    that repeat id and text are one document and get the same result. An empty table gives no rows.
    Very long texts take time in proportion to their lines.
    """
    cut = repeated_lines(docs, window, gram)
    joined = _identity(docs).join(cut, ["_id", "_th"], "left").withColumn("_lines", _lines(F.col("text")))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    # The places of lines with words; numbers in ``removed`` count these.
    worded = F.filter(places, lambda i: F.get("_lines", i).rlike(WORD))
    gone = F.transform(F.array(worded), lambda at: F.transform("removed", lambda r: F.get(at, r)))[0]
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(places, gone), lambda i: F.get("_lines", i)), "\n"))
    done = joined.withColumns({"new": text, "count": F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))})
    replaced = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        length = F.length("new").cast(docs.schema["n_chars"].dataType)
        replaced["n_chars"] = F.when(F.col("count") > 0, length).otherwise(F.col("_row.n_chars"))
    return done.select(*unpacked([c for c in docs.columns if c != "n_removed"], **replaced), F.col("count").alias("n_removed"))

"""Mixing sources to target weights, with DataFrame functions only.

Method. The words of each source's documents, laid end to end, are packed into blocks of
``block_words`` words. The mix is a sequence of output shards; how many slots each source has in each
shard is a multinomial draw (every slot of a source falls into a shard by a pseudorandom number, so
the counts per shard are multinomial given the sources' totals, and the totals meet the targets).
Slot j of a source reads block permute(j mod blocks), a pseudorandom permutation that differs by
source and by pass over the source, and blocks are joined by source and index. No pass repeats a
block, and targets stop at ``cap`` = 2 passes, so no word is taken more than twice.

A document's place in its source is a prefix sum in two levels (chunks of ids, then rows of a
chunk), so a source with a third of all rows is never sorted in one task. All numbers are integer
arithmetic on row values: a rerun, or a task that runs again, gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_RUN, WORD, packed, partitions, saved, unpacked

#: Words of one block; production sequences are longer, at the price of coarser targets.
BLOCK_WORDS = 64
#: Slots of one output shard.
SHARD_SLOTS = 1024
#: Share of all words that the mix has, most passes over a source, and weights of the sources in turn.
SHARE, CAP, WEIGHTS = 1.5, 2, (5, 2, 1)
#: Chunks that a source's ids are dealt to for prefix sums, and slots generated by one row.
CHUNKS, SPREAD = 4096, 16_384

#: A word with the white space after it; the first one also has what stands before it.
_SPACED = rf"(?:^{SPACE_RUN})?{WORD}(?:{SPACE_RUN})?"

# Fixed values of the pseudorandom functions: a prime modulus, multipliers, and odd multipliers.
_P, _A, _B, _C = 2147483647, 48271, 69621, 668265263
_ODD = (614657, 876499, 943591)


def scattered(x: Column, key: Column) -> Column:
    """A pseudorandom number below 2**31 from two non-negative integers."""
    a = (x % _P + 1) * _A % _P
    b = a.bitwiseXOR((F.floor(x / _P) + key * 7919 + 1) % _P * _C % _P)
    c = b.bitwiseXOR(F.shiftright(b, 13)) % _P * _B % _P
    return c.bitwiseXOR(F.shiftright(c, 11))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs."""
    return F.transform(F.array(value), use)[0]


def _permutation(sources: DataFrame) -> DataFrame:
    """``sources`` with what a permutation needs: the largest power of two up to blocks, a shift, and
    the turns of the ring for each pass and round."""
    turns = [scattered(F.col("rank") * 2 + turn, F.lit(i)) % F.col("blocks") for turn in range(CAP) for i in range(len(_ODD))]
    bits = F.length(F.bin("blocks")) - 1
    return sources.withColumns({"power": F.call_function("shiftleft", F.lit(1).cast("long"), bits), "shift": F.floor(bits / 2).cast("int") + 1, "turns": F.array(*turns)})


def _permuted() -> Column:
    """The block of slot j: a permutation in each pass. Rounds of invertible steps: multiply and fold
    below the power of two, then turn the whole ring."""
    turn = F.floor(F.col("j") / F.col("blocks")).cast("int")

    def round_(x: Column, i: int) -> Column:
        if i == len(_ODD):
            return x
        below = lambda v, then: F.when(v < F.col("power"), then).otherwise(v)
        mixed = below(x, x * _ODD[i] % F.col("power"))
        fold = lambda y: below(y, y.bitwiseXOR(F.call_function("shiftright", y, F.col("shift"))))
        turned = lambda z: (z + F.element_at("turns", turn * len(_ODD) + i + 1)) % F.col("blocks")
        return _let(mixed, lambda y: _let(turned(fold(y)), lambda z: round_(z, i + 1)))

    return _let(F.col("j") % F.col("blocks"), lambda x: round_(x, 0))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, sk (the source, with null told apart), source, size (words; null: 0) and th (a hash of the
    text) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("sk"),
        F.col("source").alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"),
    )


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: sk, rank, source_size, target, blocks, slots.

    A target is min(cap * size, level * weight); the level at which they add up to ``share`` of all
    words is the largest of those that result when the first i sources by size / weight are capped.
    """
    total = sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_need = Window.orderBy(F.col("most") / F.col("w"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = ranked.withColumns({"w": weight, "most": F.col("source_size") * float(cap)})
    df = df.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    df = df.withColumn("target", F.least("most", F.max("level").over(everything) * F.col("w")))
    df = df.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    return df.select("sk", "rank", "source_size", "target", "blocks", F.least(slots, F.col("blocks") * cap).cast("long").alias("slots"))


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``, the number of words of its source before the row, by chunk, id, size and text
    (rows that agree in all of these are interchangeable). Null ids are dealt to chunks by their texts."""
    own = Window.partitionBy("sk", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    chunked = sizes.withColumn("chunk", F.pmod(F.coalesce("doc_id", "th"), F.lit(CHUNKS)))
    earlier = Window.partitionBy("sk").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunked.groupBy("sk", "chunk").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    inside = chunked.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return inside.join(chunks.drop("words"), ["sk", "chunk"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "chunk")


def mixture(targets: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as rows (shard, rank, j, block): slot j of a source reads that block."""
    width = partitions(targets.sparkSession)  # a number, or adaptive execution makes these few rows one task
    shards = F.greatest(F.ceil(F.sum("slots").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / shard_slots), F.lit(1)).cast("long")
    sources = targets.where("slots > 0").select("rank", "blocks", "slots", shards.alias("shards"))
    spread = sources.withColumn("part", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SPREAD}L)"))).repartition(width, F.col("rank"), F.col("part"))
    slots = spread.withColumn("j", F.explode(F.expr(f"sequence(part * {SPREAD}L, least(slots, (part + 1) * {SPREAD}L) - 1)")))
    # The draw: how many slots of each source fall into each shard.
    drawn = slots.groupBy("rank", (scattered(F.col("j"), F.col("rank")) % F.col("shards")).alias("shard"), "blocks").agg(F.count("*").alias("n"))
    to_here = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = _permutation(drawn.withColumn("first", F.sum("n").over(to_here) - F.col("n"))).repartition(width, F.col("rank"), F.col("shard"))
    return first.withColumn("j", F.explode(F.expr("sequence(first, first + n - 1)"))).select("shard", "rank", "j", _permuted().alias("block"))


def _pieces(rows: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """Every row's parts in blocks that the mix takes: block, lo (first word), len, times."""
    taken = mixture(targets).groupBy("rank", "block").agg(F.count("*").alias("times"))
    last = F.expr(f"(start + size - 1) div {block_words}L")
    parts = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}L"), last)))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    # Spark sizes ``taken`` by the small table it is generated from; it grows with the corpus, so it
    # must never be broadcast.
    return parts.withColumns({"lo": lo - F.col("start"), "len": hi - lo}).join(taken.hint("merge"), ["rank", "block"], "left")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target (its source's), taken.

    Null and empty texts have size 0 and take no part; a null source is a source of its own, ranked
    last; a null id comes first in its source. Repeated rows are documents of their own. Sources
    without words have target 0. An empty table gives no rows; other columns are ignored.
    """
    sizes = saved(sized(docs), "sizes")
    targets = saved(source_targets(sizes, block_words=block_words), "targets")
    rows = placed(sizes).join(targets, "sk")
    out = ["doc_id", "source", "size", "source_size", "target"]
    some = _pieces(rows, targets, block_words).groupBy("rank", "start", *out).agg(F.coalesce(F.sum(F.col("len") * F.col("times")), F.lit(0)).alias("taken"))
    none = sizes.where("size = 0").join(targets, "sk").select(*out, F.lit(0).cast("long").alias("taken"))
    return some.select(*out, "taken").unionByName(none)


def mix_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as packed blocks: shard, source, slot (of its source), block, words (an array; ``block_words`` of
    them, fewer in the last block of a source). A block that two passes take is in two slots."""
    sizes = saved(sized(docs), "sizes")
    targets = saved(source_targets(sizes, block_words=block_words), "targets")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("sk"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text").dropDuplicates(["id", "sk", "th"])
    pieces = _pieces(placed(sizes).join(targets, "sk"), targets, block_words).where("times > 0").withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    held = pieces.groupBy("id", "sk", "th", "rank", "source").agg(F.collect_list(F.struct("start", "block", "lo", "len")).alias("parts")).join(texts, ["id", "sk", "th"])
    words = held.withColumn("all", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).select("rank", "source", "all", F.explode("parts").alias("p"))
    part = F.struct(F.col("p.start").alias("start"), F.slice("all", (F.col("p.lo") + 1).cast("int"), F.col("p.len").cast("int")).alias("words"))
    blocks = words.groupBy("rank", F.col("p.block").alias("block")).agg(F.first("source").alias("source"), F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["words"])).alias("words"))
    return mixture(targets, shard_slots).join(blocks.hint("merge"), ["rank", "block"]).select("shard", "source", F.col("j").alias("slot"), "block", "words")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: the columns of ``docs``, the text cut down to the words that the mix
    takes (those of a second pass again after those of the first), n_chars its length. Words keep the
    white space after them, the first of a text also what stands before it, so a text taken whole is
    unchanged; passes are parted by a space where none is. Rows of which nothing is taken go, and so
    do rows without words: the mix holds none of them. Null ids and sources are values like others; rows
    that repeat get what falls to each, in the order of a hash of the whole row, so reruns agree. An empty
    table gives no rows."""
    sizes = saved(sized(docs), "sizes")
    targets = saved(source_targets(sizes, block_words=block_words), "targets")
    pieces = _pieces(placed(sizes).join(targets, "sk"), targets, block_words).where("times > 0")
    rows = pieces.groupBy("doc_id", "sk", "th", "start").agg(F.sort_array(F.collect_list(F.struct("block", "lo", "len", "times"))).alias("parts"))
    same = rows.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), F.col("sk").alias("_sk"), F.col("th").alias("_th")).agg(F.sort_array(F.collect_list(F.struct("start", "parts"))).alias("_rows"))
    keys = ["_id", "_no_id", "_sk", "_th"]
    row = F.col("_row")
    keyed = packed(docs).withColumns({
        "_id": F.coalesce(row["doc_id"].cast("long"), F.lit(-1)),
        "_no_id": row["doc_id"].isNull(),
        "_sk": F.coalesce(F.concat(F.lit("s"), row["source"]), F.lit("n")),
        "_th": F.xxhash64(F.coalesce(row["text"], F.lit(""))),
    })
    # Rows of one id, source and text differ in other columns at most; their hash gives them an order.
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("_row")))
    met = keyed.join(same, keys).withColumn("_turn", turn).where(F.col("_turn") <= F.size("_rows"))
    met = met.withColumns({"_parts": F.element_at("_rows", F.col("_turn"))["parts"], "_words": F.regexp_extract_all(row["text"], F.lit(_SPACED), F.lit(0))})
    piece = lambda p: F.array_join(F.slice("_words", (p["lo"] + 1).cast("int"), p["len"].cast("int")), "")
    in_pass = lambda t: lambda p: p["times"] >= t
    passes = F.array(*(F.array_join(F.transform(F.filter("_parts", in_pass(t)), piece), "") for t in range(1, CAP + 1)))
    apart = lambda a, b: F.concat(a, F.when((a != "") & (b != "") & ~a.rlike(rf"{SPACE_RUN}\z") & ~b.rlike(rf"\A{SPACE_RUN}"), " ").otherwise(""), b)
    met = met.withColumn("_text", F.reduce(passes, F.lit(""), apart))
    replaced = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return met.select(*unpacked(docs.columns, **replaced))

"""Jaccard similarity join of documents on word shingles with a token-group matrix.

Documents link when 100 * |A and B| >= ``percent`` * |A or B| over their sets of ``words``-word
shingles (tokens). Exact, and without all pairs of any group:

1. Every stretch of text sends its distinct tokens, dealt by hash to buckets in packed blocks, and a
   bucket returns those that more than one document has, with a code that grows with their number. A
   token that all documents hold reaches its bucket once a stretch. A linked document shares
   ``percent`` of its tokens, so a document with fewer shared tokens links with nothing and is done.
   This drops most documents, whatever boilerplate they hold. Equal sets are one class from here on,
   and classes are numbered, so ids that repeat or are null name nothing.
2. A class is indexed under its prefix, rare tokens first: two linked classes share a token among
   their first n - ceil(percent * n) + 1, and as their first common one it bounds how large the other may
   be. Within each token every class is compared with ``CENTRES`` classes only. Verified links make
   components.
3. Classes are partitioned into groups of similar ones: the classes of a component, or those without a
   link that share the smallest token hash of their sets (equal with the probability of their
   similarity). Groups are split where their sets hold more than ``GROUP_TOKENS``. The token-group
   matrix has a row for each token of a group's union, with the members that hold it. A class asks a
   group when a prefix token of both allows a link and the group has another component. The overlap with
   the group's union bounds every member's; only a group whose union holds enough is opened, and the
   rows of the class's tokens then give the exact overlap with each member. What a group finds leaves as
   a forest, not as pairs. No link between components is lost.

Hashes are 64 bits in a set and 48 (``TOKEN_BYTES``) between sets: two unequal shingles of one pair of
500-word documents are taken for equal with probability 1e-9, which matters only to pairs on the very
threshold, and among 10**13 distinct tokens one in thirty looks shared though it is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import dealt_back, lean, packed, partitions, salt_of, saved, small_batches, unpacked
from cairn.llm.components import connected
from cairn.llm.sentencepiece_codec import _one, stretches

WORDS, PERCENT = 5, 80
#: Bytes of a token's hash beyond a document's own set.
TOKEN_BYTES = 6
SALTS = 64
#: Bytes of text whose tokens are packed together, and tokens that a bucket counts at a time.
STRETCH, COUNTED = 4 << 20, 1 << 21
#: Centres of a token: the smallest number, the least share of own tokens, and pseudorandom ones.
CENTRES = 8
#: Tokens of a group's members, and of the classes that ask it, in one row.
GROUP_TOKENS = 1 << 15

_NO_ID = (1 << 63) - 1
_INFO = np.dtype([("id", "<i8"), ("th", "<i8"), ("n", "<i8"), ("cls", "V16")])
_PACKED = "bucket int, stretch long, size int, tokens binary, extra binary, codes binary"
_SETS = "id long, th long, n long, cls binary, home long, tokens binary, codes binary"
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes: A-Z in lower case, words between white space;
    a text of fewer words is one shingle; one without words (or null) has none."""
    # Lower case comes before the cast: Arrow 23 reads a slice that was cast from a wrong offset.
    plain = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    cut = pc.ascii_split_whitespace(plain)
    coded = cut.values.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(word > 0)])[cut.offsets.to_numpy()]
    word = word[word > 0]

    def mixed(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for x in parts:
            h = (h * _M) ^ x
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    count = len(word) - words + 1
    rolled = mixed([word[i : i + count] for i in range(words)]) if count > 0 else word[:0]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out.append(np.unique(rolled[a : b - words + 1]) if b - a >= words else mixed([word[i : i + 1] for i in range(a, b)]) if b > a else word[:0])
    return out


def _bytes_of(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _tokens_of(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view("<u8").ravel()


def _needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def _packer(buckets: int, words: int):
    """Of every stretch its distinct tokens by bucket, with their number of documents there, and one
    row (size 0) with what its documents are and which document has which of the tokens, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches(batches, 2, STRETCH):
            for at in range(0, len(rows), 1 << 16):
                part = rows.slice(at, 1 << 16)
                sets = shingle_sets(_one(part.column(2)), words)
                info = np.zeros(len(sets), _INFO)
                info["id"], info["th"], info["n"] = part.column(0).to_numpy(), part.column(1).to_numpy(), [len(s) for s in sets]
                marks = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                info["cls"] = np.frombuffer(b"".join(marks), "V16")
                name = int.from_bytes(blake2b(info.tobytes(), digest_size=8).digest(), signed=True)
                first: dict[bytes, int] = {}
                for i, mark in enumerate(marks):
                    first.setdefault(mark, i)
                own = [i for i in first.values() if len(sets[i])]
                tokens = np.concatenate([np.empty(0, np.uint64), *(sets[i] for i in own)]) >> np.uint64(64 - 8 * TOKEN_BYTES)
                of = np.repeat(np.array(own, "<u2"), [len(sets[i]) for i in own])
                order = np.argsort(tokens, kind="stable")
                starts = _starts(tokens[order])
                distinct, times = tokens[order][starts], np.diff(np.append(starts, len(tokens)))
                out = [(name % buckets, name, 0, info.tobytes(), of[order].tobytes(), times.astype("<u4").tobytes())]
                bucket = distinct * np.uint64(buckets) >> np.uint64(8 * TOKEN_BYTES)
                edges = _starts(bucket)
                for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
                    out.append((int(bucket[a]), name, int(b - a), _bytes_of(distinct[a:b]), np.minimum(times[a:b], 255).astype(np.uint8).tobytes(), b""))
                yield _batch(out, _PACKED)

    return run


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _sharer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the tokens that another document has too: the tokens, a mask of them within the
    block, and their frequency codes. A bucket is held packed and counted ``COUNTED`` tokens at a time."""
    blocks = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] == 0:
                yield _batch([row], _PACKED)
            else:
                blocks.append(row)
    if not blocks:
        return
    turns = -(-sum(b[2] for b in blocks) // COUNTED)
    lo, hi = min(int(_tokens_of(b[3][:TOKEN_BYTES])[0]) for b in blocks), max(int(_tokens_of(b[3][-TOKEN_BYTES:])[0]) for b in blocks)
    bounds = np.array([lo + (hi + 1 - lo) * t // turns for t in range(1, turns)], np.uint64)
    cuts = [[0, *np.searchsorted(_tokens_of(b[3]), bounds), b[2]] for b in blocks]
    codes = [np.zeros(b[2], np.uint8) for b in blocks]
    for t in range(turns):
        tokens = np.concatenate([_tokens_of(b[3][TOKEN_BYTES * c[t] : TOKEN_BYTES * c[t + 1]]) for b, c in zip(blocks, cuts, strict=True)])
        times = np.concatenate([np.frombuffer(b[4][c[t] : c[t + 1]], np.uint8) for b, c in zip(blocks, cuts, strict=True)])
        if not len(tokens):
            continue
        order = np.argsort(tokens, kind="stable")
        starts = _starts(tokens[order])
        total = np.add.reduceat(times[order].astype(np.int64), starts)
        code = np.empty(len(tokens), np.uint8)
        code[order] = np.repeat(np.minimum(255, np.round(8 * np.log2(total))).astype(np.uint8), np.diff(np.append(starts, len(tokens))))
        at = 0
        for own, c in zip(codes, cuts, strict=True):
            own[c[t] : c[t + 1]] = code[at : at + c[t + 1] - c[t]]
            at += c[t + 1] - c[t]
    for (bucket, name, size, data, _, _), own in zip(blocks, codes, strict=True):
        mask = own > 0
        yield _batch([(bucket, name, size, _bytes_of(_tokens_of(data)[mask]), np.packbits(mask).tobytes(), own[mask].tobytes())], _PACKED)


def _gatherer(percent: int):
    """A row for each document; those that can link have their shared tokens, in order, and codes."""

    def close(own: list[tuple], answers: dict[int, tuple]) -> pa.RecordBatch:
        # Equal stretches have one name and one content: each gets its rows, and one set of answers.
        info, of, times = np.frombuffer(own[0][0], _INFO), np.frombuffer(own[0][1], "<u2"), np.frombuffer(own[0][2], "<u4")
        rows: list[tuple] = [(int(r["id"]), int(r["th"]), int(r["n"]), r["cls"].tobytes(), None, None, None) for r in info]
        if answers:
            by_token = [answers[b] for b in sorted(answers)]
            mask = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for n, _, m, _ in by_token]).astype(bool)
            tokens, codes = np.concatenate([_tokens_of(t) for _, t, _, _ in by_token]), np.concatenate([np.frombuffer(c, np.uint8) for _, _, _, c in by_token])
            of, which = of[np.repeat(mask, times)], np.repeat(np.arange(len(tokens)), times[mask])
            order = np.argsort(of, kind="stable")
            of, which = of[order], which[order]
            edges = _starts(of)
            for a, b in zip(edges, np.append(edges[1:], len(of)), strict=True):
                row = rows[of[a]]
                if b - a >= _needed(row[2], percent):
                    mine = which[a:b]
                    rows[of[a]] = (*row[:4], int(tokens[mine[0]]), _bytes_of(tokens[mine]), codes[mine].tobytes())
        return _batch(rows * len(own), _SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, answers = None, [], {}
        for batch in batches:
            for bucket, name, size, tokens, extra, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if own:
                        yield close(own, answers)
                    now, own, answers = name, [], {}
                if size == 0:
                    own.append((tokens, extra, codes))
                else:
                    answers[bucket] = (size, tokens, extra, codes)
        if own:
            yield close(own, answers)

    return run


def token_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, th, n, cls (a digest of the set) of every row, and of those that can link the shared tokens,
    their codes and home, the smallest of them."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    shared = keyed.mapInArrow(lean(_packer(n, words)), _PACKED).repartitionById(n, F.col("bucket")).mapInArrow(lean(_sharer), _PACKED)
    gathered = shared.repartition(n, F.col("stretch")).sortWithinPartitions("stretch").mapInArrow(lean(_gatherer(percent)), _SETS)
    return saved(gathered, "sets")


def _prefixes(percent: int):
    """(token, id, n, own, cap) for the shared tokens in each class's prefix, rare tokens first. own is
    the share of tokens that no other document has, in 1/256. cap is the largest set with which a
    link can have this token as its first common one: of the tokens before it none is common, so the
    rest must hold the overlap that the two sizes ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, n, data, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, code = _tokens_of(data), np.frombuffer(codes, np.uint8)
                own = n - len(tokens)
                keep = np.lexsort((tokens, code))[: max(0, n - _needed(n, percent) + 1 - own)]
                cap = (100 + percent) * (n - own - np.arange(len(keep))) // percent - n
                for col, x in zip(out, (tokens[keep].astype(np.int64), np.full(len(keep), i), np.full(len(keep), n), np.full(len(keep), 256 * own // n), cap), strict=True):
                    col.append(x)
            cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["token", "id", "n", "own", "cap"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, nu, nv, a, b = (c.to_pylist() for c in batch.columns)
            both = [len(np.intersect1d(_tokens_of(x), _tokens_of(y), assume_unique=True)) for x, y in zip(a, b, strict=True)]
            good = [100 * k >= percent * (m + n - k) for k, m, n in zip(both, nu, nv, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()).filter(pa.array(good, pa.bool_())), pa.array(v, pa.int64()).filter(pa.array(good, pa.bool_()))], ["u", "v"])

    return run


def _first_common(percent: int) -> Column:
    """Whether u and v can link with this row's token as their first common one."""
    return (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & (F.col("nv") <= F.col("cu")) & (F.col("nu") <= F.col("cv"))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that link. A class that many pairs name is copied once per salt in use."""
    dealt = pairs.withColumn("salt", salt_of(F.col("u"), SALTS))
    copies = dealt.select("v", "salt").distinct().join(classes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("b")), "v")
    met = dealt.join(copies, ["v", "salt"]).join(classes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("a")), "u")
    return met.select("u", "v", "nu", "nv", "a", "b").mapInArrow(lean(_linked(percent)), "u long, v long")


def _to_centres(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of every class with the centres of its tokens. Centres are gathered over salts and dealt
    back to the salts in use."""
    dealt = postings.withColumn("salt", salt_of(F.col("id"), SALTS))
    orders = [F.lit(0).cast("long"), F.col("own"), *(F.xxhash64("id", F.lit(r)) for r in range(CENTRES - 2))]
    names = [f"c{i}" for i in range(CENTRES)]
    top = dealt_back(dealt, ["token"], {c: F.min(F.struct(o.alias("o"), "id", "n", "cap")) for o, c in zip(orders, names, strict=True)}, {c: F.min(c) for c in names})
    near = dealt.join(top, ["token", "salt"])
    pairs = near.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("cap").alias("cu"), F.explode(F.array_distinct(F.array(*(F.struct(F.col(c)["id"].alias("v"), F.col(c)["n"].alias("nv"), F.col(c)["cap"].alias("cv")) for c in names)))).alias("p"))
    return pairs.select("u", "nu", "cu", "p.*").where("u <> v").where(_first_common(percent)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _grouped(classes: DataFrame, components: DataFrame) -> DataFrame:
    """``classes`` with component (their own number, if they have no link) and group: a key (home or
    component), and a part of it where the key's sets hold more than ``GROUP_TOKENS``."""
    known = classes.join(components.withColumnRenamed("node", "id"), "id", "left")
    linked = F.col("component").isNotNull()
    keyed = known.withColumns({"kind": linked, "key": F.coalesce("component", "home"), "component": F.coalesce("component", "id")})
    parts = dealt_back(keyed.withColumn("salt", salt_of(F.col("id"), SALTS)), ["kind", "key"], {"size": F.sum(F.length("codes").cast("long"))}, {"size": F.sum("size")})
    dealt = keyed.withColumn("salt", salt_of(F.col("id"), SALTS)).join(parts, ["kind", "key", "salt"])
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / GROUP_TOKENS))
    return dealt.withColumn("group", F.struct("kind", "key", part.alias("part"))).select("id", "n", F.length("codes").cast("long").alias("size"), "tokens", "component", "group")


def _asked(postings: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """(id, group): the groups that a class may link with by a prefix token of both, where the group has
    a component other than the class's."""
    known = postings.join(grouped.select("id", "component", "group"), "id").withColumn("salt", salt_of(F.col("id"), SALTS))
    entries = known.groupBy("token", "group").agg(F.min("n").alias("small"), F.max("n").alias("large"), F.max("cap").alias("top"), F.min("component").alias("from"), F.max("component").alias("to"))
    mixed = dealt_back(known, ["token"], {"least": F.min("component"), "most": F.max("component")}, {"least": F.min("least"), "most": F.max("most")}).where("least <> most")
    index = entries.join(mixed.select("token", "salt"), "token")
    other = (F.col("from") != F.col("to")) | (F.col("from") != F.col("component"))
    fits = (F.col("large") * 100 >= F.col("n") * percent) & (F.col("small") * percent <= F.col("n") * 100) & (F.col("small") <= F.col("cap")) & (F.col("n") <= F.col("top"))
    return known.select("token", "salt", "id", "n", "cap", "component").join(index, ["token", "salt"]).where(other & fits).select("id", "group").distinct()


class GroupMatrix:
    """The matrix of one group: its tokens, and the members that hold each."""

    def __init__(self, members: list[dict]) -> None:
        self.ids = [m["id"] for m in members]
        self.components = np.array([m["component"] for m in members])
        self.sizes = np.array([m["n"] for m in members])
        sets = [_tokens_of(m["tokens"]) for m in members]
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        self._of, starts = of[order], _starts(tokens[order])
        self.union, self._starts, self._counts = tokens[order][starts], starts, np.diff(np.append(starts, len(tokens)))

    def linked(self, n: int, tokens: np.ndarray, component: int, percent: int) -> np.ndarray:
        """The members of other components that link with a class of n tokens."""
        at = np.searchsorted(self.union, tokens)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == tokens]
        # A link with m tokens asks for percent * (n + m) / (100 + percent) common ones, and m is at least the
        # smallest member's and percent of n.
        if len(at) * (100 + percent) * 100 < percent * (n * 100 + max(n * percent, int(self.sizes.min()) * 100)):
            return np.empty(0, np.int64)
        counts = self._counts[at]
        rows = np.repeat(self._starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(self._of[rows], minlength=len(self.ids))
        return np.flatnonzero((100 * both >= percent * (n + self.sizes - both)) & (self.components != component))


def _opener(percent: int):
    """Links of each row's asking classes with its group's members, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for members, asking in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                matrix, root = GroupMatrix(members), {}

                def top(x: int, root: dict[int, int] = root) -> int:
                    while root.get(x, x) != x:
                        root[x] = x = root.get(root[x], root[x])
                    return x

                for q in asking:
                    for i in matrix.linked(q["n"], _tokens_of(q["tokens"]), q["component"], percent):
                        a, b = top(q["component"]), top(int(matrix.components[i]))
                        if a != b:
                            root[a] = b
                            u.append(q["id"])
                            v.append(matrix.ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _across_groups(postings: DataFrame, classes: DataFrame, components: DataFrame, percent: int) -> DataFrame | None:
    """Links between components, by the token-group matrix, as a forest of each of its rows; None where
    no class asks a group."""
    grouped = saved(_grouped(classes, components), "grouped")
    asked = saved(_asked(postings, grouped, percent), "asked")
    if asked.isEmpty():
        return None
    # The classes that ask a group meet it in packs of bounded size.
    sized = asked.join(grouped.select("id", "size"), "id").withColumn("salt", salt_of(F.col("id"), SALTS))
    packs = dealt_back(sized, ["group"], {"size": F.sum("size")}, {"size": F.sum("size")}).withColumn("packs", F.ceil(F.col("size") / GROUP_TOKENS))
    dealt = sized.join(packs.drop("size"), ["group", "salt"]).select("group", "id", F.pmod(F.xxhash64("id", F.lit(2)), F.col("packs")).alias("pack"))
    one = F.struct("id", "n", "component", "tokens")
    asking = dealt.join(grouped.drop("group"), "id").groupBy("group", "pack").agg(F.collect_list(one).alias("asking"))
    members = grouped.groupBy("group").agg(F.collect_list(one).alias("members")).join(packs.select("group", "packs").distinct(), "group")
    rows = members.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1))).join(asking, ["group", "pack"])
    return rows.select("members", "asking").mapInArrow(lean(_opener(percent)), "u long, v long")


def _found(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, th, n, component (a number; null without shingles) and least (its smallest id) of every row."""
    sets = token_sets(docs, words, percent)
    salted = sets.withColumn("salt", salt_of(F.struct("id", "th"), SALTS))
    by_salt = salted.where("n > 0").groupBy("cls", "salt").agg(F.min("id").alias("least"))
    # The numbers are fixed by being written.
    classed = by_salt.groupBy("cls").agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts"))
    numbered = saved(classed.withColumn("number", F.monotonically_increasing_id()), "classes")
    held = sets.where("tokens IS NOT NULL").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "home", "tokens", "codes")))
    classes = saved(held.join(numbered, "cls").select(F.col("number").alias("id"), "n", "home", "tokens", "codes"), "held")
    prefixes = classes.select("id", "n", "tokens", "codes").mapInArrow(lean(_prefixes(percent)), "token long, id long, n long, own long, cap long")
    postings = saved(prefixes, "postings")
    links = saved(_verified(_to_centres(postings, percent), classes, percent), "links")
    components = connected(links)
    across = _across_groups(postings, classes, components, percent)
    if across is not None:
        components = connected(links.union(across))
    known = numbered.join(components.withColumnRenamed("node", "number"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    known = known.select("cls", "salts", "component", F.col("least").alias("of_class"), salt_of(F.col("number"), SALTS).alias("salt"))
    least = dealt_back(known, ["component"], {"least": F.min("of_class")}, {"least": F.min("least")})
    labelled = known.join(least, ["component", "salt"]).select("cls", "component", "least", F.explode("salts").alias("salt"))
    return salted.join(labelled, ["cls", "salt"], "left").select("id", "th", "n", "component", F.coalesce("least", "id").alias("least"))


def _real(id_: Column) -> Column:
    return F.when(id_ != _NO_ID, id_)


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Null and empty texts, and texts without words, have no shingles and are components of their own.
    Rows that repeat an id or a text are documents of their own (equal texts link). A null id counts
    as the largest: its component_id is null unless it links with a row that has an id. Ties between
    equally frequent tokens fall by hash and change no link. An empty table gives no rows; other columns
    are ignored.
    """
    found = _found(docs, words, percent)
    return found.select(_real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), _real(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, unchanged, that stay when each component keeps the row with the smallest
    doc_id (null last; then by a hash of the text; of equal rows one). Rows without shingles stay."""
    found = _found(docs, words, percent)
    best = found.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("id").alias("_id"), F.col("th").alias("_th"))).alias("k")).select("k.*", F.lit(True).alias("_one"))
    empty = found.where("n = 0").select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.lit(False).alias("_one")).distinct()
    keyed = packed(docs).withColumns({"_id": F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_NO_ID)), "_th": F.xxhash64(F.coalesce("_row.text", F.lit("")))})
    kept = keyed.join(best.union(empty), ["_id", "_th"])
    turn = F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.lit(0)))
    return kept.withColumn("_turn", turn).where((F.col("_turn") == 1) | ~F.col("_one")).select(*unpacked(docs.columns))

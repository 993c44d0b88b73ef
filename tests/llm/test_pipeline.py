"""The toxicity learner against a plain loop, and the pipeline's stages against brute force."""

import importlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from cairn.llm import line_dedup, mixing, ngram_join, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_ftrl(examples, labels, epochs):
    """FTRL-proximal, one coordinate after the other, on values that are log count ratios."""
    pos, neg = sum(labels), len(labels) - sum(labels)
    seen = {y: Counter(f for e, own in zip(examples, labels, strict=True) if own == y for f in e) for y in (0, 1)}
    value = {}
    for f in set(seen[0]) | set(seen[1]):
        if seen[0][f] + seen[1][f] >= toxicity.LEAST_TEXTS:
            r = math.log((seen[1][f] + 1) / (pos + 2)) - math.log((seen[0][f] + 1) / (neg + 2))
            if r:
                value[f] = r
    z, n = Counter(), Counter()
    weight = {}

    def w(f):
        l1 = 0.0 if f == "bias" else toxicity.L1
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for e, y in zip(examples, labels, strict=True):
            own = [(f, value[f]) for f in e if f in value] + [("bias", 1.0)]
            weight = {f: w(f) for f, _ in own}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(weight[f] * x for f, x in own)))))
            for f, x in own:
                g = (p - y) * x
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * weight[f]
                n[f] += g * g
    return {f: w(f) * value[f] for f in value if abs(z[f]) > toxicity.L1}, w("bias")


def test_learning_equals_a_plain_loop():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha beta gamma delta vile scum trash fine good words here".split()) for _ in range(rng.randint(3, 25))) for _ in range(150)]
    labels = np.array([float("vile" in t or ("scum" in t and "trash" in t)) for t in texts])
    of, found = toxicity._distinct(*toxicity.features(pa.array(texts)))
    examples = [found[of == i] for i in range(len(texts))]
    at, weights, bias = toxicity.learn(examples, labels, epochs=3)
    expected, base = plain_ftrl([[int(f) for f in e] for e in examples], [int(y) for y in labels], 3)
    assert {int(f) for f in at} == set(expected) and 5 < len(at) < len({int(f) for e in examples for f in e})
    assert all(abs(expected[int(f)] - x) < 1e-6 for f, x in zip(at, weights, strict=True)) and abs(base - bias) < 1e-9
    # The score of a text is the logistic of its features' weights.
    model = toxicity.Model(at, weights, bias)
    for e, s in zip(examples, model.scores(pa.array(texts)), strict=True):
        assert abs(s - 1 / (1 + math.exp(-(base + sum(expected.get(int(f), 0.0) for f in e))))) < 1e-5


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents and labels, small enough for brute force, with rows of every awkward kind."""
    rng = random.Random(41)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu", "we", "xo")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "\n".join(say(14) for _ in range(4))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = say(rng.randint(20, 60)) + (" vile scum trash" if bad else "") + "\n" + say(10)
        if i % 10 == 1:
            text += "\n" + shared
        rows.append((i, text, "en", f"s{i % 3}" if i % 11 else None))
        labels.append((i, 1, int(bad)))
    clean = rows[7][1]
    near = " ".join([*clean.split()[:-1], "other"])
    rows += [(400, clean, "en", "s0"), (401, near, "en", "s1"), (401, near, "en", "s1"), (402, "", "en", "s1"), (403, None, None, "s0"), (None, say(40), "en", "s2"), (None, None, None, None), (404, "one\ttwo\n\n  three", "en", "s2"), (405, say(3000), "en", "s0")]
    full = [(i, t, g, s, None if t is None else len(t), "extra") for i, t, g, s in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, removed string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def tuples(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_and_run(spark, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
    before = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = before.columns
    after = {}
    for name, stage in pipeline.STAGES:
        stage(spark, before, corpus).write.parquet(f"{corpus}/out-{name}")
        before = after[name] = spark.read.parquet(f"{corpus}/out-{name}")
        if name != "sentencepiece":
            assert before.columns == columns and all(r.n_chars is None or r.n_chars == len(r.text) for r in before.collect())

    given, kept = tuples(spark.read.parquet(f"{corpus}/documents.parquet")), tuples(after["toxicity"])
    # Toxicity: what holds the words goes, on rows that learning never saw as well; the rest is unchanged.
    assert not kept - given
    gone = given - kept
    unseen = [r for r in given if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum((r in gone) == ("vile" in (r[1] or "")) for r in unseen) >= 0.98 * len(unseen)
    assert sum((r in gone) == ("vile" in (r[1] or "")) for r in given) >= 0.98 * len(given)

    # Line dedup: every document stays; of a passage's lines one copy is left, and no other line goes.
    lined = tuples(after["line_dedup"])
    assert Counter((i, s) for i, _, s in lined.elements()) == Counter((i, s) for i, _, s in kept.elements())
    first = {}
    for i, t, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        for line in (t or "").split("\n"):
            if len(line.split()) >= line_dedup.GRAM:
                first.setdefault(line, i)
    for i, t, _ in lined:
        assert all(first[line] == i for line in (t or "").split("\n") if line in first)

    # N-gram join: one of each group of brute force, the smallest id; documents without words stay.
    rows = sorted(lined.elements(), key=lambda r: (r[0] is None, r[0] or 0))
    sets, group = [shingles(t) for _, t, _ in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= ngram_join.PERCENT * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    best = {}
    for r, g, s in zip(rows, group, sets, strict=True):
        if s:
            best.setdefault(g, r)
    joined = tuples(after["ngram_join"])
    assert joined == Counter(best.values()) + Counter(r for r, s in zip(rows, sets, strict=True) if not s)
    assert sum(joined.values()) < len(rows)

    # Mixing: the words that the mix takes, none of them from elsewhere, none more than twice; white space kept.
    mixed = tuples(after["mixing"])
    taken = Counter()
    for r in mixing.mix(after["ngram_join"]).collect():
        taken[r.source] += r.taken
    assert Counter({s: n for s, n in taken.items() if n}) == sum((Counter({s: len(t.split())}) for _, t, s in mixed.elements()), Counter())
    have = {(i, s): t for i, t, s in joined}
    for i, t, s in mixed:
        if i is not None:
            source = Counter(have[i, s].split())
            assert all(n <= 2 * source[w] for w, n in Counter(t.split()).items())
    assert any("\n" in t for _, t, _ in mixed)

    # SentencePiece: the library's ids and what they decode to.
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in after["sentencepiece"].collect())
    assert coded == Counter((i, len(m.encode(t)), tuple(m.encode(t)), m.decode(m.encode(t))) for i, t, _ in mixed.elements())

    # run() does the same, and leaves its result alone behind.
    done = pipeline.run(spark, corpus)
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in done.collect()) == coded
    folder = os.path.dirname(done.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == ["sentencepiece"]


def test_run_of_an_empty_table(spark, corpus, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0

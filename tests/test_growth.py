"""What queries shuffle and hold, on small tables: figures that must not grow faster than the input."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions.analysis import Analyzer, _tokens_of
from cairn.operators import ann, fts, vector
from cairn.plans import query_string
from cairn.schema import PK, IndexParams
from cairn.sources.revisions import Store

WORDS = [f"{a}{b}{c}" for a in "bcdfgklm" for b in ("al", "er", "ion", "ux") for c in "nprstvz"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"k{i}", " ".join(rng.choice(WORDS) + rng.choice("aeiou") for _ in range(300)) + (" idoit" if i % 9 == 0 else " idiot idioit" if i % 7 == 0 else "")) for i in range(400)]
    path = str(tmp_path_factory.mktemp("texts") / "t")
    spark.createDataFrame(rows, f"{PK} string, body string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def shuffled(spark, action):
    """An action's result, and the bytes that it shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        time.sleep(1)  # the figures are brought up to date by tasks, at times
        spark.range(4).count()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of size
    try:
        out = action()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return out, total() - before


@pytest.mark.parametrize(("text", "wanted"), [("idoit~1", lambda i: i % 9 == 0 or i % 7 == 0), ("idi?t idio*", lambda i: i % 7 == 0 and i % 9), ("[idio TO idoz}", lambda i: i % 9 == 0 or i % 7 == 0)])
def test_pattern_scans_shuffle_only_what_matches(spark, texts, text, wanted):
    tree = query_string.parse(text, Analyzer(), "body")
    found, size = shuffled(spark, lambda: vector.top(fts.search(texts, texts, "body", tree, Analyzer(), PK), 500).collect())
    assert {r[PK] for r in found} == {f"k{i}" for i in range(400) if wanted(i)}
    assert size < 60_000, size  # the texts have 700 KB


def test_plain_ngrams_need_no_python(spark):
    odd = ["", "a", "abcd", "\U0001f600x\U0001f601yz", "line\nbreak\r\n", None]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string")
    for least, most, filters in ((2, 3, ()), (1, 1, ("lowercase",)), (9, 10, ())):
        ngrams = Analyzer("ngram", filters, {"ngram_min": least, "ngram_max": most})
        made = df.orderBy("i").select(ngrams.column(F.col("text")).alias("t"))
        assert [r.t for r in made.collect()] == [None if t is None else ngrams.tokens(t) for t in odd]
        assert "Python" not in made._jdf.queryExecution().toString()


def test_python_tokens_are_made_of_few_texts_at_once(spark):
    folded, stemmed = (Analyzer("standard", ("lowercase", "ascii_folding", *more)) for more in ((), ("stemmer",)))
    texts = pa.array([None, ""] + [" ".join(f"running{i}x{k}" for k in range(300)) for i in range(600)])
    run, wanted = _tokens_of(folded), [None if t is None else folded.tokens(t) for t in texts.to_pylist()]
    tracemalloc.start()
    made = run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist() == wanted
    assert peak < 6_000_000, peak  # 180,000 tokens have 60 bytes each as objects
    made = spark.createDataFrame([("Élan running",)], "text string").select(stemmed.column(F.col("text")))
    assert made.first()[0] == ["elan", "run"] and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 128


def test_graphs_are_searched_a_shard_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 25)
    x = np.random.default_rng(2).normal(size=(120, 8)).astype(np.float32)
    rows = spark.createDataFrame([(f"k{i:03}", [float(c) for c in v]) for i, v in enumerate(x)], f"{PK} string, v array<float>")
    index, store = IndexParams("vamana", {"metric": "l2"}), Store(spark, str(tmp_path / "g"))
    ann.build(store, "index", rows, index)
    near = ann.candidates(ann.load(store, "index"), index, x[7], "l2", 10, {"list_size": 1000}, None)
    assert {r[PK] for r in near.collect()} == {f"k{i:03}" for i in range(120)}
    plan = near._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan and "MapInPandas [" not in plan  # else a batch is all shards of a partition


def test_an_index_is_built_without_a_shuffle_of_postings(spark, texts, tmp_path):
    folder = str(tmp_path / "i")
    facts, size = shuffled(spark, lambda: fts.TextIndex.build(texts, "body", Analyzer(), PK, folder))
    index = fts.TextIndex.read(spark, folder, facts)
    n = index.postings.count()
    assert index.documents == 400 and index.lengths.count() == 400 and n > 90_000
    assert index.vocabulary.agg(F.sum("df")).first()[0] == n
    assert size < n, size  # terms and their counts alone; postings take more than ten bytes each
    assert fts.TextIndex.read(spark, folder, '{"documents": 1, "tokens": 1}') is None

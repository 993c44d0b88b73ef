"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage gets all that its predecessor kept, as written and reread Parquet, and calls one operator:

1. toxicity: documents that the classifier rejects go.
2. line dedup: later repeated runs of lines go from the texts.
3. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays; documents without
   words are no group and stay.
4. mixing: texts are cut down to the words that the mix takes; documents with none of them go.
5. SentencePiece: token ids, and the text that they decode to.

All but the last return the columns of ``documents``. Null texts count as empty, null ids as the
largest; an empty table gives an empty result at each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import line_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from cairn.llm.common import delete, scratch_root, scratch_tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``documents`` and keep what scores below the cut."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; every document stays."""
    return line_dedup.dedup_lines(docs).drop("n_removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the words that the mix takes."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded (the text that the ids decode to)."""
    coded = sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the classifier nor the encoding; tests/llm/test_pipeline.py checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. What a stage
    wrote for itself, and its predecessor's rows, go as soon as its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/cairn/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        with scratch_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            delete(spark, f"{base}/{last}")
        last = name
    return docs

"""The corpus pipeline: toxic documents go, repeated lines and near-duplicates go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns a DataFrame;
all but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_replay, line_runs, minhash_dedup, mixing, toxicity
from tidemark.session import configure, materialize, table

#: A document with this probability of being toxic goes.
TOXIC = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold. Labels are those of ``labels`` that are not held out."""
    configure(spark)
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    return docs.filter(toxicity.probability(spark, model)(F.col("text")) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines; those that held nothing else go. ``n_chars`` follows the text."""
    configure(spark)
    deduped = line_runs.without_later_copies(docs)
    left = (F.col("n_deleted") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    kept = deduped.filter(left).withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long"))
                                           .otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    configure(spark)
    return minhash_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, up to three."""
    configure(spark)
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes, per row of the mix."""
    configure(spark)
    rows = bpe_replay.digests(docs, tokenizers.path(VOCABULARY), tokenizers.PATTERN)
    return rows.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Training, sketches and merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    docs = table(configure(spark), sf_dir.rstrip("/"), "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir.rstrip("/"))
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs

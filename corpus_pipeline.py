"""From raw documents to a training mix: five stages, each written and read again.

toxicity         documents scored 0.3 or more go
simhash_dedup    of each group of near-duplicates the document with the smallest id stays
suffix_dedup     passages of 100 bytes or more that occur earlier are cut out of the text
decontamination  documents that hold a benchmark item go
mixing           sources are brought to their target weights; the result has one row for each time
                 that the mix takes a document, in shards, with mix_shard, mix_place and mix_pass
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orisite.llm import decontaminate, mixing, simhash_dedup, suffix_dedup, toxicity
from orisite.llm.common import quoted
from orisite.llm.queries import held_out, table
from orisite.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.where(~held_out(4)), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < 0.3).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_duplicates(docs, shingle=3, max_bits=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(docs, width=100)
    text = F.col(f"`{done.columns[-2]}`")  # kept_text
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Hash fingerprints, learned scores and seeded draws have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

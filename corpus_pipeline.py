"""The corpus pipeline: toxicity, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet in the shared folder and read again as the next one's docs.
Classifiers are fitted on the stage's own documents and the labels of sf_dir. The mixture's rates are at least the posterior
of not being junk: clean documents are repeated, and only junk is dropped, until all domains have their targets. SQL can't express the classifiers, SimHash or BPE, so there is no ORACLE_SQL.

Rows: each stage works on all rows that its predecessor kept, and all but the last return the columns of documents, further ones included. A null or empty
text is never toxic, equals no other null, is in no near group, counts no tokens and has null or no ids. Of equal and of near texts the least
doc_id stays; repeated rows collapse to one before the mixture repeats some. An empty table passes through all stages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from labelfacts.llm import bpe, exact_dedup, mixing, shared, simhash, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    floor = np.array([0.0 if domain == "junk" else 1.0 for domain in mixing.WEIGHTS])
    return mixing.mix(docs, _labels(spark, sf_dir), floor=floor, budget=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with shared.scratch(spark) as made:  # a stage's own tables go when its result is written
            docs = shared.written(stage(spark, docs, sf_dir))
            own = made.pop()
        if last:
            shared.delete(spark, last)
        last = own
    return docs

"""Operator 6: exact deduplication by progressive refinement.

Documents are grouped by byte length; those that share it, by a hash of their first PREFIX characters too; only those that share both
have their full content hashed (SHA-256). The two first steps aggregate numbers with map-side combine, and only hashes and ids are
grouped: no text moves.

Rows: the text decides, byte for byte. Of equal texts the row with the least doc_id stays (a null doc_id counts as greatest;
among equal doc_ids the least of the other orderable columns); repeated rows collapse to one. Empty texts are equal to each other.
A null text equals nothing and stays. Further columns are carried along as they are, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import every, keep_first, small, unused, written

PREFIX = 128


def _keys(text: Column) -> tuple[Column, Column]:
    return F.octet_length(text), F.xxhash64(F.substring(text, 1, PREFIX))


def suspects(docs: DataFrame) -> DataFrame:
    """(n, p): lengths and prefix hashes that more than one row has."""
    length, prefix = _keys(F.col("text"))
    keys = docs.where("text is not null").select(length.alias("n"), prefix.alias("p"))
    lengths = keys.groupBy("n").count().where("count > 1").select("n")
    return small(written(keys.join(lengths, "n", "left_semi").groupBy("n", "p").count().where("count > 1").select("n", "p")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, keep) of every row: group_id is the least doc_id with the same text."""
    length, prefix = _keys(F.col("text"))
    own = docs.select("doc_id", "text", length.alias("n"), prefix.alias("p"))
    marked = own.join(suspects(docs).withColumn("s", F.lit(True)), ["n", "p"], "left").select("doc_id", F.when(F.col("s"), F.sha2("text", 256)).alias("h"))
    alone = marked.where("h is null").select("doc_id", F.col("doc_id").alias("group_id"))
    # the groups' least ids by a combined aggregate, so that a text with thousands of copies is no large window
    least = marked.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("group_id"))
    grouped = marked.where("h is not null").join(least, "h").select("doc_id", "group_id")
    return alone.unionAll(grouped).withColumn("keep", F.expr("doc_id <=> group_id"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each distinct text, all columns as they are."""
    n, p, n2, p2, s, h = unused(docs, "n", "p", "n2", "p2", "s", "h")
    length, prefix = _keys(F.col("text"))
    keys = suspects(docs).select(F.col("n").alias(n2), F.col("p").alias(p2), F.lit(True).alias(s))
    marked = docs.select(*every(docs), length.alias(n), prefix.alias(p)).join(keys, (F.col(n) == F.col(n2)) & (F.col(p) == F.col(p2)), "left")
    marked = marked.select(*every(docs), F.when(F.col(s), F.unhex(F.sha2(F.col("text").cast("string"), 256))).alias(h))
    return keep_first(marked, h, docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, group_id, doc_id = group_id AS keep
FROM (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS group_id FROM documents)
"""

"""spark-submit entry: ``python -m labelfacts.plans TASK -i IN -o OUT`` with TASK facts (TSV word boxes), upc or expiry (annotation JSON)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources import readers
from . import labels


def main() -> None:
    p = argparse.ArgumentParser(prog="labelfacts")
    p.add_argument("task", choices=["facts", "upc", "expiry"])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--format", default="parquet", choices=["parquet", "csv", "json"])
    a = p.parse_args()
    spark = SparkSession.builder.appName("labelfacts").getOrCreate()
    if a.task == "facts":
        made = labels.nutrition_facts(readers.word_boxes_tsv(spark, a.input))
    else:
        made = {"upc": labels.barcodes, "expiry": labels.expiry_dates}[a.task](readers.annotations_json(spark, a.input))
    made.write.mode("overwrite").format(a.format).save(a.output)


if __name__ == "__main__":
    main()

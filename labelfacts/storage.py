"""Intermediate tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes of rows below which a written table is broadcast; beyond, Spark joins by shuffle. Both give the same rows.
BROADCAST_BYTES = 32 << 20


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again. What several branches of a plan read is then computed once, and no lost executor takes it along.
    The folder is spark.checkpoint.dir; only where that isn't set and all runs on this machine, as in tests, one is made here."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="labelfacts-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Mark a written table of flat columns for broadcast if its rows take no more than ``most`` bytes; else leave the join to Spark."""
    width = F.lit(0)
    for f in df.schema.fields:
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if isinstance(f.dataType, (StringType, BinaryType)) else F.lit(8))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df

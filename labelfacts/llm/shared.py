"""What several operators need: the shared folder, written tables, size-checked broadcasts, distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows below which a written table is broadcast; beyond, Spark joins by shuffle. Both give the same rows.
BROADCAST_BYTES = 64 << 20
#: Edges below which the last contraction runs as one task; beyond, by rounds of stars.
ONE_TASK_EDGES = 4_000_000
_made: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. Only where none is set and all runs on this machine, as in tests, one is made here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="labelfacts-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made inside are removed at its end, but for those taken off the list; whatever reads them has to be written by then."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        for path in _made.pop():
            delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends at files that no lost executor takes along."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``folder`` that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one like each of the names."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n += "_"
        there.add(n.lower())
        out.append(n)
    return out


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: Spark looks their names up as paths, so columns only have numbers on the way in and out."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" for i in range(b.num_columns)])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(numbered, plain).toDF(*schema.names)


def _width(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col(name)), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(col(name)), F.lit(0)) * F.lit(8 if isinstance(kind.elementType, T.NumericType) else 64) + F.lit(24)
    return F.lit(8)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Mark a written table for broadcast if its rows take no more than ``most`` bytes; else leave the join to Spark."""
    total = None
    for f in df.schema.fields:
        w = _width(f.name, f.dataType).cast("long")
        total = w if total is None else total + w
    size = df.agg(F.sum(total)).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text with seeds of their own: together they stand for it. Null texts have none, and differ by a number."""
    return [F.when(text.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text))]


def first_of(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Of each group the row with the least doc_id (null last), then the least other orderable columns, as a whole row."""
    kinds = dict(rows.dtypes)
    order = [F.col("doc_id").isNull(), F.col("doc_id"), *(col(c) for c in columns if c not in ("doc_id", "text") and "map<" not in kinds[c] and "variant" not in kinds[c])]
    row = unused(rows, "row")[0]
    # numbered names: a struct takes any, but its fields are asked for by name
    whole = F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    picked = rows.groupBy(col(by)).agg(F.min_by(whole, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias(row))
    return picked.select(*(F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(columns)))


def keep_first(marked: DataFrame, key: str, columns: list[str], most: int | None = None) -> DataFrame:
    """The rows where ``key`` is null, and of each value of it the first row, by doc_id (null last), then the other orderable columns.

    Only keys and ids are aggregated. A whole row is moved only where more rows of one group have its least doc_id, or, beyond ``most``
    bytes of groups, where it has a key."""
    ids = written(marked.where(col(key).isNotNull()).select(col(key).alias("k"), F.col("doc_id").alias("id")))
    least = ids.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("k", "least")
    least = written(least)
    tied = written(ids.join(small(least, most), "k").where("id <=> least").groupBy("k").count().where("count > 1").select("k"))
    some = tied.count() > 0
    k, low, tie = unused(marked, "k", "least", "tie")
    table = least.join(small(tied.withColumn("tie", F.lit(True)), most), "k", "left").select(F.col("k").alias(k), F.col("least").alias(low), F.coalesce("tie", F.lit(False)).alias(tie))
    table = small(written(table), most)
    own = [col(c) for c in columns]

    def chosen(rows: DataFrame) -> DataFrame:
        flagged = rows.join(table, col(key) == F.col(k), "left")
        least_row = F.col("doc_id").eqNullSafe(F.col(low))
        main = flagged.where(F.col(k).isNull() | (least_row & ~F.col(tie))).select(*own)
        return main.unionAll(first_of(flagged.where(F.col(k).isNotNull() & least_row & F.col(tie)), k, columns)) if some else main

    if table.isEmpty():
        return marked.select(*own)
    if _is_broadcast(table):
        return chosen(marked)
    # rows without a key would all meet in one task of a shuffled join
    return marked.where(col(key).isNull()).select(*own).unionAll(chosen(marked.where(col(key).isNotNull())))


def _is_broadcast(df: DataFrame) -> bool:
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and the least node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        differ = p != q
        if not differ.any():
            return nodes, nodes[parent]
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            nodes, root = roots(*(np.concatenate(x) for x in zip(*held)))
            held = [(nodes[nodes != root], root[nodes != root])]
            size = min(len(nodes), 1_000_000)
    if held:
        nodes, root = roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], names=["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) of every node of the edges (a, b: BIGINT), root the least node of its component.

    Each partition runs union-find over its own edges and keeps a forest. The forests are joined by alternating large
    and small stars (Kiveris et al. 2014) with a checkpoint a round, or in one task once few edges are left; both give the same.
    Loops and repeated edges don't matter; no edges give no rows.
    """
    schema = "a long, b long"
    folder(edges.sparkSession)
    edges = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a <> b")
    edges = edges.mapInArrow(_contract, schema).checkpoint()
    seen = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
        if now[0] <= one_task:
            edges = edges.coalesce(1).mapInArrow(_contract, schema)
            break
        seen = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.expr("min(b) over (partition by a)")
        large = both.withColumn("m", F.least("a", least)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        with_m = large.withColumn("m", least)
        edges = with_m.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct().checkpoint()
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())

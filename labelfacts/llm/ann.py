"""Operator 4: approximate nearest neighbours from randomly rotated one-bit codes (RaBitQ, Gao and Long 2024).

Vectors are assigned to about sqrt(n) lists by Lloyd's iterations over all of them. Within a list, the residual x - c is scaled to length 1,
rotated by a random orthogonal matrix and cut to its sign bits; kept are the packed bits, |x - c|, and the inner product of the residual with its code, by
which estimates are corrected. A query's rotated residual is quantised to QUERY_BITS bits; bitwise counts give the estimate of each inner product and
a bound of its error, so lower and upper bounds of every distance. Vectors whose lower bound is within the k-th least
upper bound are reranked by exact distance. Queries are the vectors whose vec_id is a multiple of QUERY_EVERY, against all vectors.

A query is first asked in its own list, then in its nearest other lists that the triangle inequality doesn't rule out, with the distance
of the k-th neighbour so far as the bound. How many lists that are is measured, not set: PROBE queries (a bounded sample) are compared with all vectors
exactly, and the least number of lists that hold TARGET of their neighbours is asked; where vectors fill many dimensions evenly those are most lists, in clustered
ones few. Lists and the queries that ask them are cut into blocks, so that no list, however many vectors it holds, has to fit in one task.

Rows: a row without vec_id or with an empty vector, or with a null or NaN in it, is left out. Vectors are compared with those of equal dimension only, each
dimension by an index of its own. Of rows that share a vec_id the least vector counts. Neighbours are other vec_ids; equal distances go by the lesser id.
With fewer than k + 1 vectors every other one is a neighbour; a vector alone has none, and an empty table gives none. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

K, ITERATIONS, QUERY_BITS, EPSILON, QUERY_EVERY = 10, 4, 4, 2.2, 20
#: Queries that are compared with all vectors to choose how many lists are asked, and the share of their neighbours these have to hold.
PROBE, TARGET = 128, 0.97
#: Vectors of a list, and queries that ask it, in one task.
LIST_ROWS, QUERY_ROWS = 65_536, 8_192
BLOCK = 128


def rotation(d: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """List of each vector."""
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((half - x[s : s + 4096] @ centroids.T).argmin(1) for s in range(0, len(x), 4096))])


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (64 to a word), length, and inner product with the code, of each residual."""
    d = turn.shape[0]
    length = np.sqrt((residual * residual).sum(1))
    unit = np.zeros((len(residual), d), np.float32)
    unit[:, : residual.shape[1]] = residual / np.maximum(length, 1e-20)[:, None]
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1).view(np.uint64), length, np.abs(turned).sum(1) / np.sqrt(d)


def bounds(code: np.ndarray, length: np.ndarray, inner: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x vectors) of squared distances; queries are residuals to the same centroid."""
    d = turn.shape[0]
    q_length = np.sqrt((queries * queries).sum(1))
    unit = np.zeros((len(queries), d), np.float32)
    unit[:, : queries.shape[1]] = queries / np.maximum(q_length, 1e-20)[:, None]
    turned = unit @ turn
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    level = np.rint((turned - low) / step).astype(np.uint8)
    counted = np.zeros((len(queries), len(code)), np.int32)
    for j in range(QUERY_BITS):
        plane = np.packbits((level >> j) & 1, axis=1).view(np.uint64)
        for w in range(code.shape[1]):
            counted += np.bitwise_count(plane[:, None, w] & code[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(code).sum(1, dtype=np.int32)
    signed = 2 * (step * counted + low * ones) - (step * level.sum(1, keepdims=True, dtype=np.int64) + low * d)
    safe = np.maximum(inner, 1e-6)
    cosine = signed / np.sqrt(d) / safe
    error = EPSILON * np.sqrt(np.maximum(1 - safe**2, 0)) / safe / np.sqrt(max(d - 1, 1)) + step * 0.5 / safe
    square, cross = q_length[:, None] ** 2 + length**2, 2 * q_length[:, None] * length
    return square - cross * np.minimum(cosine + error, 1), square - cross * np.maximum(cosine - error, -1)


def search(ids: np.ndarray, x: np.ndarray, code: np.ndarray, length: np.ndarray, inner: np.ndarray, centroid: np.ndarray, q_ids: np.ndarray, q: np.ndarray, reach: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, squared distance) of each query's k nearest in the list that are no further than its reach."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), BLOCK):
        part = q[s : s + BLOCK]
        for t in range(0, len(x), 32768):
            e = min(len(x), t + 32768)
            lower, upper = bounds(code[t:e], length[t:e], inner[t:e], part - centroid, turn)
            own = q_ids[s : s + BLOCK, None] == ids[None, t:e]
            upper[own], lower[own] = np.inf, np.inf
            limit = reach[s : s + BLOCK].astype(np.float64)
            if e - t > k:
                limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
            a, b = np.nonzero((lower <= limit[:, None]) & ~own)
            exact = ((part[a].astype(np.float64) - x[t + b]) ** 2).sum(1)
            keep = exact <= reach[s + a]
            out.append((s + a[keep], t + b[keep], exact[keep]))
    a, b, exact = (np.concatenate(v) if out else np.zeros(0, np.int64) for v in (zip(*out) if out else ((), (), ())))
    by = np.lexsort((ids[b], exact, a))
    a, b, exact = a[by], b[by], exact[by]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], b[rank < k], exact[rank < k]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _centroids(table: DataFrame, lists: int, d: int, seed: int) -> np.ndarray:
    """Lloyd's iterations over all vectors; a step is one aggregate."""
    centroids = matrix(table.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(lists).select("v").toArrow()["v"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((lists, d)), np.zeros(lists, np.int64)
        for b in batches:
            x = matrix(b.column(0))
            at = nearest(x, centroids)
            by = np.argsort(at, kind="stable")
            own, cut = np.unique(at[by], return_index=True)
            total[own] += np.add.reduceat(x[by], cut, axis=0, dtype=np.float64)
            count += np.bincount(at, minlength=lists)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), _lists(total[some])], names=["list", "n", "s"])

    for _ in range(ITERATIONS if lists > 1 else 0):
        summed = F.array(*(F.sum(F.col("s")[i]) for i in range(d)))
        got = table.select("v").mapInArrow(step, "list long, n long, s array<double>").groupBy("list").agg(F.sum("n").alias("n"), summed.alias("s")).toArrow()
        centroids[got["list"].to_numpy()] = matrix(got["s"]) / got["n"].to_numpy()[:, None]
    return centroids


def _ranks(indexed: DataFrame, probe: pa.Table, centroids: np.ndarray, k: int) -> np.ndarray:
    """For each true neighbour of the probed queries, how many of their nearest lists have to be asked to meet it."""
    ids, q = probe["vec_id"].to_numpy(), matrix(probe["v"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 8192):
                part = b.slice(s, 8192)
                there, x, of = part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy()
                square = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T
                square[ids[:, None] == there] = np.inf
                few = min(k, len(x))
                at = np.argpartition(square, few - 1, axis=1)[:, :few]
                row = np.repeat(np.arange(len(q)), few)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(square[row, at.ravel()].astype(float)), pa.array(of[at.ravel()])], names=["q", "d", "list"])

    by = Window.partitionBy("q").orderBy("d", "list")
    found = indexed.select("vec_id", "v", "list").mapInArrow(best, "q long, d double, list long").where("d < double('inf')").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).toArrow()
    gap = (centroids * centroids).sum(1) - 2 * q @ centroids.T
    place = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1)
    return place[found["q"].to_numpy(), found["list"].to_numpy()] + 1


def neighbours(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, target: float = TARGET, lists: int | None = None, list_rows: int = LIST_ROWS, query_rows: int = QUERY_ROWS, seed: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance) of the k nearest others of each vector whose vec_id is a multiple of ``every``; distance is Euclidean."""
    v = F.col("embedding").cast("array<float>")
    clean = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") > 0).where(~F.exists("v", lambda e: e.isNull() | F.isnan(e)))
    table = written(clean.groupBy("vec_id", F.size("v").alias("d")).agg(F.min("v").alias("v")))
    sizes = table.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("q")).where("n > 1 and q > 0").orderBy("d").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    found = [_neighbours(table.where(F.col("d") == r["d"]).select("vec_id", "v"), r["d"], r["n"], r["q"], k, every, target, lists, list_rows, query_rows, seed) for r in sizes]
    by = Window.partitionBy("vec_id", "dim").orderBy("d", "neighbour_id")
    return reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", F.sqrt("d").alias("distance"))


def _neighbours(table: DataFrame, d: int, n: int, queries: int, k: int, every: int, target: float, lists: int | None, list_rows: int, query_rows: int, seed: int) -> DataFrame:
    """(vec_id, neighbour_id, d, dim) that hold each query's k nearest, d squared, of vectors of one dimension."""
    lists = min(n, max(1, int(np.sqrt(n))) if lists is None else lists)
    turn = rotation(-(-d // 64) * 64, seed)
    centroids = _centroids(table, lists, d, seed)
    shared = table.sparkSession.sparkContext.broadcast((centroids, turn))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turn = shared.value
        for b in batches:
            x = matrix(b.column(1))
            at = nearest(x, centroids)
            code, length, inner = encode(x - centroids[at], turn)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns, _lists(code.view(np.int64)), pa.array(length.astype(np.float32)), pa.array(inner.astype(np.float32))], names=["list", "vec_id", "v", "code", "length", "inner"])

    indexed = written(table.mapInArrow(index, "list long, vec_id long, v array<float>, code array<long>, length float, inner float"))
    is_query = F.col("vec_id") % every == 0
    radius, blocks = np.zeros(lists), np.ones(lists, np.int64)
    for r in indexed.groupBy("list").agg(F.max("length").alias("radius"), F.count("*").alias("n")).toArrow().to_pylist():
        radius[r["list"]], blocks[r["list"]] = r["radius"], -(-r["n"] // list_rows)
    probe = indexed.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(PROBE).select("vec_id", "v").toArrow()
    ranks = np.sort(_ranks(indexed, probe, centroids, k))
    most = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) if len(ranks) else lists
    # queries that ask one list: at most all of them
    sides = max(1, -(-queries // query_rows))

    def placed(rows: DataFrame, of_list: bool) -> DataFrame:
        """Rows with (block, side): a list's row is in one block and meets all sides, a query is on one side and meets all blocks of the list."""
        number = F.array(*(F.lit(int(x)) for x in blocks)) if lists <= 256 else None
        if (blocks == 1).all():
            n_blocks = F.lit(1)
        elif number is not None:
            n_blocks = F.element_at(number, (F.col("list") + 1).cast("int"))
        else:
            return _placed_by_join(rows, of_list)
        return _spread(rows, n_blocks, of_list)

    def _placed_by_join(rows: DataFrame, of_list: bool) -> DataFrame:
        sizes = rows.sparkSession.createDataFrame([(int(i), int(b)) for i, b in enumerate(blocks) if b > 1], "list long, nb int")
        return _spread(rows.join(F.broadcast(sizes), "list", "left"), F.coalesce("nb", F.lit(1)), of_list).drop("nb")

    def _spread(rows: DataFrame, n_blocks, of_list: bool) -> DataFrame:
        h = F.xxhash64("vec_id", F.lit(seed + 2))
        if of_list:
            one = rows.withColumn("block", F.pmod(h, n_blocks).cast("int"))
            return one.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))) if sides > 1 else one.withColumn("side", F.lit(0))
        one = rows.withColumn("side", F.pmod(h, F.lit(sides)).cast("int"))
        return one.withColumn("block", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))

    def ask(there: pa.Table, asked: pa.Table) -> pa.Table:
        centroids, turn = shared.value
        if not there.num_rows or not asked.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        ids, q_ids = there["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        code = there["code"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(there.num_rows, -1)
        a, b, exact = search(ids, matrix(there["v"]), code, there["length"].to_numpy(), there["inner"].to_numpy(), centroids[there["list"][0].as_py()], q_ids, matrix(asked["v"]), asked["far"].to_numpy(), turn, k)
        return pa.table({"vec_id": pa.array(q_ids[a]), "neighbour_id": pa.array(ids[b]), "d": pa.array(exact)})

    def asked_in(rows: DataFrame) -> DataFrame:
        """(vec_id, neighbour_id, d) of queries (list, vec_id, v, far) in the lists they name."""
        both = placed(indexed, True).groupBy("list", "block", "side").cogroup(placed(rows, False).groupBy("list", "block", "side"))
        return both.applyInArrow(ask, "vec_id long, neighbour_id long, d double")

    start = indexed.where(is_query).select("list", "vec_id", "v")
    first = written(asked_in(start.withColumn("far", F.lit(float("inf")))))
    by = Window.partitionBy("vec_id").orderBy("d", "neighbour_id")
    far = first.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("vec_id", F.col("d").alias("far"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _ = shared.value
        half = (centroids * centroids).sum(1)
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                x, far = matrix(part.column(2)), np.sqrt(part.column(3).to_numpy())
                gap = np.sqrt(np.maximum((x * x).sum(1)[:, None] + half - 2 * x @ centroids.T, 0))
                some = min(most, gap.shape[1])
                best = np.argpartition(gap, some - 1, axis=1)[:, :some]
                own = best == part.column(0).to_numpy()[:, None]
                a, c = np.nonzero(~own & (np.take_along_axis(gap, best, axis=1) - radius[best] <= far[:, None] + 1e-6))
                take = pa.array(a)
                yield pa.RecordBatch.from_arrays([pa.array(best[a, c]), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take)], names=["list", "vec_id", "v", "far"])

    chosen = start.join(far, "vec_id", "left").select("list", "vec_id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far")).mapInArrow(choose, "list long, vec_id long, v array<float>, far double")
    return first.unionAll(asked_in(chosen)).withColumn("dim", F.lit(d))


def op4_rabitq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

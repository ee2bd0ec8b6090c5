"""Operator 1: toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and byte grams is trained with numpy from documents confirmed as toxic (P) and all
documents, taken as unlabelled (U). The risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)) (Kiryo et al. 2017): the part of
the unlabelled risk that toxic documents in U explain is taken off, and where it turns negative its gradient is reversed.
U is never sampled: in how many documents a bucket stands is counted over all of them, what is left of each (its buckets that may get a weight)
is written once, and every step sums the gradient over that table.

Rows: a null or empty text has no features; it is scored by the bias, and never counts as toxic. Repeated rows count as often as they stand there,
are scored alike and all kept; ties can't arise. Labels that are null, or of no document, are ignored; of several labels of one document the
greatest counts. Without a confirmed toxic document no document is toxic. An empty table gives an empty one. Any further
columns are kept by ``drop_toxic`` whatever their names; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import map_rows, written

BITS = 18
#: Bound of the sample of labelled rows: confirmed toxic documents that the classifier is fitted on.
MAX_POSITIVE = 4000
STEPS, RATE, L2 = 50, 0.12, 1e-5
#: A bucket gets a weight if its share in P is above that in U by this factor and by this many standard errors.
LIFT, Z = 1.6, 3.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float


Side = tuple[np.ndarray, np.ndarray, int]


def _sets(docs: DataFrame) -> list[np.ndarray]:
    """Distinct feature buckets of each document, on the driver: the sample is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in tx.feature_sets(b.column(0), BITS)], pa.binary())], names=["f"])

    table = docs.select(F.col("text").cast("string")).mapInArrow(run, "f binary").toArrow()
    return [np.frombuffer(x.as_py(), np.int32) for x in table.column(0)]


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket stands, and the number of documents; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, data, at in tx.pieces(b.column(0)):
                total += np.bincount(tx.sets(data, at, BITS)[0], minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], names=["bucket", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def chosen(cp: np.ndarray, np_: int, cu: np.ndarray, nu: int, z: float = Z, lift: float = LIFT) -> np.ndarray:
    """Buckets that may get a weight. None gets a negative one, so the rest of a long text can't outvote what is toxic in it."""
    pooled = (cp + cu + 1) / (np_ + nu + 2)
    score = (cp / np_ - cu / nu) / np.sqrt(pooled * (1 - pooled) * (1 / np_ + 1 / nu))
    ratio = np.log((cp / np_ + 1e-6) / (cu / nu + 1e-6))
    return np.flatnonzero((score > z) & (ratio > np.log(lift)) & (cp >= 3))


def side_gradient(side: Side, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """Sums over a side's documents, of the sigmoid loss of calling each not toxic, and of its gradient in the weights and the bias. (at, row, n): a document of each entry's place."""
    at, row, n = side
    loss = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], n) + b, -30, 30)))
    slope = loss * (1 - loss)
    return float(loss.sum()), np.append(np.bincount(at, slope[row], len(w)), slope.sum())


def fit_pu(positive: Side, size: int, nu: int, unlabelled: Callable[[np.ndarray, float], tuple[float, np.ndarray]], prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with sigmoid loss: ``size`` weights and the bias. ``unlabelled`` sums loss and gradient over U."""
    np_ = positive[2]
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        lp, gp = side_gradient(positive, w, b)
        lu, gu = unlabelled(w, b)
        away = gu / nu - prior * gp / np_  # of R_U(-) - pi * R_P(-)
        # R_P(+) is 1 - R_P(-); a negative part steps back from the overfitted part alone
        g = away - prior * gp / np_ if lu / nu - prior * lp / np_ >= 0 else -away
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


def _side(sets: list[np.ndarray], index: np.ndarray) -> Side:
    at = index[np.concatenate([np.zeros(0, np.int32), *sets])]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return at[at >= 0], row[at >= 0], len(sets)


def remains(docs: DataFrame, index: np.ndarray) -> DataFrame:
    """(n, at, size): runs of documents, by the weights' numbers in each and how many there are; written."""
    shared = docs.sparkSession.sparkContext.broadcast(index.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, at in tx.pieces(b.column(0)):
                bucket, row = tx.features(data, at, BITS)
                own = shared.value[bucket]
                key = tx.distinct((row[own >= 0].astype(np.int64) << BITS) | own[own >= 0])
                size = np.bincount(key >> BITS, minlength=len(at) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([len(at) - 1]), pa.array([(key & ((1 << BITS) - 1)).astype(np.int32).tobytes()]), pa.array([size.astype(np.int32).tobytes()])], names=["n", "at", "size"])

    return written(docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, at binary, size binary"))


def _summed(table: DataFrame) -> Callable[[np.ndarray, float], tuple[float, np.ndarray]]:
    """Loss and gradient over the written table, a job a call."""

    def of(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, g = 0.0, np.zeros(len(w) + 1)
            for batch in batches:
                for n, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                    more, slope = side_gradient((np.frombuffer(at, np.int32), np.repeat(np.arange(n), np.frombuffer(size, np.int32)), n), w, b)
                    loss, g = loss + more, g + slope
            yield pa.RecordBatch.from_arrays([pa.array([np.append(loss, g).tobytes()])], names=["g"])

        got = sum(np.frombuffer(x, np.float64) for x in table.mapInArrow(run, "g binary").toArrow()["g"].to_pylist())
        return (0.0, np.zeros(len(w) + 1)) if isinstance(got, int) else (got[0], got[1:])

    return of


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, seed: int = 7) -> Model:
    """P: documents whose label says toxic, up to ``max_positive`` of them in the order of a hash; U: all documents, whatever their
    label. The prior, if not given, is the toxic share of all labels."""
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        share = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = min(max(share or 0.01, 0.001), 0.9)
    own = docs.select("doc_id", "text")
    ids = marked.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_positive)
    positive = _sets(own.join(F.broadcast(ids), "doc_id"))
    none = Model(np.zeros((1 << BITS, 1), np.float32), -1.0, prior)
    if not positive:
        return none
    cu, nu = bucket_counts(own)
    cp = np.bincount(np.concatenate(positive), minlength=1 << BITS).astype(float)
    keep = chosen(cp, len(positive), cu.astype(float), nu)
    if not len(keep):
        return none
    index = np.full(1 << BITS, -1)
    index[keep] = np.arange(len(keep))
    w, bias = fit_pu(_side(positive, index), len(keep), nu, _summed(remains(own, index)), prior)
    weights = np.zeros((1 << BITS, 1), np.float32)
    weights[keep, 0] = w
    return Model(weights, bias, prior)


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(column: pa.Array) -> np.ndarray:
        weights, bias = shared.value
        return tx.linear(column, weights, BITS)[:, 0] + bias

    return score


def score(docs: DataFrame, model: Model, threshold: float = 0.0) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row; toxicity is the classifier's margin, toxic where it is above the threshold and there is a text."""
    margin = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = margin(b.column(1))
            full = pa.compute.binary_length(b.column(1).cast(pa.large_string()).fill_null("")).to_numpy() > 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s > threshold) & full)], names=["doc_id", "toxicity", "toxic"])

    own = docs.select("doc_id", F.col("text").cast("string"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns as they are."""
    margin, at = _scorer(docs, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.compute.binary_length(b.column(at).cast(pa.large_string()).fill_null("")).to_numpy()
            yield b.filter(pa.array((margin(b.column(at)) <= threshold) | (size == 0)))

    return map_rows(docs, run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))

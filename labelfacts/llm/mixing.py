"""Operator 7: mixing sources to target weights with soft membership.

A softmax classifier over hashed text features, fitted with numpy on a bounded sample of a labelled table, gives every document a
posterior over domains. Document i with n_i tokens (words between white space) and posterior p_i adds r_i * n_i * p_id expected tokens to
domain d when it is taken at rate r_i. The rates minimise the squared difference of these totals from total * weight_d,
each over the domain's present size (or a hundredth of its target, if that is more), under r_i >= floor, by accelerated projected gradient steps with a 1 / n_i metric from r_i = 1, as long as the curvature met allows. The
table of posteriors is written once; a step, one taken back too, is one aggregate over it and adds a few numbers, from which the rates are replayed. Every REBASE
steps the rates so far are written, so that a step never replays more. Should the totals miss their targets, a warning says by how much.

Rows: a null text, or one without a token, has 0 tokens and the domains' prior as posterior; it gets a rate, but can't change a total. Repeated
rows are documents of their own. Labels that are null, or of no document, are ignored; of several labels of one document the least quality counts.
Without any label all domains are equally likely. A domain without tokens stays at 0 whatever its target, and one with next to none doesn't drive the rates up. Ties don't arise: equal texts get equal
rates. ``mix`` keeps all columns as they are, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import every, map_rows, unused, written

BITS = 17
#: Bound of the sample of labelled rows that the classifier is fitted on.
MAX_LABELLED = 6000
#: Share of the mixture's expected tokens that each domain is to have.
WEIGHTS = {"en": 0.58, "fr": 0.14, "de": 0.14, "es": 0.10, "junk": 0.04}
STEPS, TOLERANCE, REBASE = 200, 1e-4, 10
#: A domain's size counts as this share of its target at least.
SCARCE = 0.01
#: A step is longer than the last by this factor, and tried again as a shorter one where that was too much.
LONGER = 1.1


def domain() -> Column:
    """Domain of a labelled document: junk where its quality is 0, else its language."""
    return F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang"))


def fit_softmax(buckets: np.ndarray, cut: np.ndarray, y: np.ndarray, classes: int, epochs: int = 8, batch: int = 128, rate: float = 0.03, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and biases, by Adam on the cross-entropy of batches of rows in their order; row i has the features
    buckets[cut[i]:cut[i + 1]], which together have the length 1."""
    n = len(y)
    truth = np.eye(classes)[y]
    w, b = np.zeros((1 << BITS, classes), np.float32), np.log(truth.mean(0) + 1e-3)
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb, vb = np.zeros(classes), np.zeros(classes)
    step, steps = 0, epochs * -(-n // batch)
    for _ in range(epochs):
        for s in range(0, n, batch):
            step += 1
            e = min(n, s + batch)
            own, at = buckets[cut[s] : cut[e]], cut[s : e + 1] - cut[s]
            size = np.diff(at)
            scale = 1 / np.sqrt(np.maximum(size, 1))
            z = tx.row_sums(w[own], at) * scale[:, None] + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - truth[s:e]) / (e - s)
            each = np.repeat(d * scale[:, None], size, axis=0)
            g = np.stack([np.bincount(own, each[:, c], 1 << BITS) for c in range(classes)], axis=1).astype(np.float32)
            g += np.float32(l2 / n) * w
            gb = d.sum(0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            now = rate * (1 - (step - 1) / steps)
            one, two = 1 / (1 - 0.9**step), 1 / (1 - 0.99**step)
            w -= np.float32(now) * (m * np.float32(one)) / (np.sqrt(v * np.float32(two)) + np.float32(1e-8))
            b = b - now * (mb * one) / (np.sqrt(vb * two) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, domains: list[str], label: Column | None = None, most: int = MAX_LABELLED, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The classifier, from up to ``most`` labelled documents in the order of a hash, fitted by one task: the sample is bounded."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select("doc_id").join(marks, "doc_id", "left_semi").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    named = docs.select("doc_id", F.col("text").cast("string"), "lang").join(F.broadcast(ids.join(marks, "doc_id")), "doc_id")
    rows = named.select("text", (domain() if label is None else label).alias("domain"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("at")).where(F.col("domain").isin(domains))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in tx.feature_sets(part.column(0), BITS)], pa.binary()), part.column(1), part.column(2)], names=["f", "domain", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_buffer(), np.int32) for x in b.column(0))]), np.array([len(x.as_buffer()) // 4 for x in b.column(0)], np.int64), [domains.index(x) for x in b.column(1).to_pylist()], b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        size, y, key = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        by, begin = np.argsort(key, kind="stable"), np.cumsum(size) - size
        flat = np.concatenate([h[0] for h in held])
        del held
        cut = np.append(0, np.cumsum(size[by]))
        flat = flat[np.repeat(begin[by] - cut[:-1], size[by]) + np.arange(cut[-1])]
        w, b = fit_softmax(flat, cut, y[by], len(domains))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([b.tobytes()])], names=["w", "b"])

    got = rows.mapInArrow(features, "f binary, domain string, at long").repartition(1).mapInArrow(fit, "w binary, b binary").toArrow()
    if not got.num_rows:
        return np.zeros((1 << BITS, len(domains)), np.float32), np.zeros(len(domains))
    return np.frombuffer(got["w"][0].as_buffer(), np.float32).reshape(-1, len(domains)), np.frombuffer(got["b"][0].as_buffer(), np.float64)


def _posterior(shared):
    """Tokens and posterior of each text of a column."""

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        weights, bias = shared.value
        n, z = np.zeros(len(column), np.int64), np.zeros((len(column), len(bias)))
        for start, data, at in tx.pieces(column):
            rows = len(at) - 1
            n[start : start + rows] = np.bincount(tx.spans(data, at)[2], minlength=rows)
            bucket, cut = tx.sets(data, at, BITS)
            z[start : start + rows] = tx.row_sums(weights[bucket], cut) / np.sqrt(np.maximum(np.diff(cut), 1))[:, None]
        z += bias
        p = np.exp(z - z.max(1, keepdims=True))
        return n, p / p.sum(1, keepdims=True)

    return run


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, h, tokens, p) of every row; h is xxhash64 of the text."""
    at = _posterior(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = at(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), _lists(p)], names=["doc_id", "h", "tokens", "p"])

    own = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string"))
    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], *T._parse_datatype_string("h long, tokens long, p array<double>").fields]))


State = tuple[np.ndarray, np.ndarray, float]


def replay(p: np.ndarray, moves: np.ndarray, floor: float | np.ndarray, state: State | None = None) -> State:
    """The rates after the steps whose gradients in the domains are ``moves``, the momentum point after them, and its weight. A floor by domain holds by posterior."""
    floor = p @ floor if np.ndim(floor) else floor
    x, y, t = state or (np.ones(len(p)), np.ones(len(p)), 1.0)
    for g in moves:
        new = np.maximum(floor, y - p @ g)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / ahead * (new - x), ahead
    return x, y, t


def fit_rates(table: DataFrame, weights: np.ndarray, floor: float | np.ndarray = 0.0, budget: float | None = 1.0, steps: int = STEPS, rebase: int = REBASE) -> np.ndarray:
    """The moves that ``replay`` needs; ``table`` has tokens and p. total = budget * tokens of the table; None: the least, 1 at least, that the floor lets all domains meet."""
    k = len(weights)
    now_at, weight, tail = table.select("tokens", "p", F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), 1.0, np.zeros((0, k))

    def job(gram: bool, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The gram matrix if asked for; after one more move the totals of the rates and of the momentum point, and how far the rates are from the momentum point before it, squared."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k + 2 * k + 1)
            for b in batches:
                n = b.column(0).to_numpy().astype(float)
                p = b.column(1).flatten().to_numpy().reshape(-1, k)
                before = replay(p, tail, floor, (b.column(2).to_numpy(), b.column(3).to_numpy(), weight))
                x, y, _ = replay(p, move, floor, before)
                total += np.concatenate([(p.T @ (p * n[:, None])).ravel() if gram else np.zeros(k * k), p.T @ (n * x), p.T @ (n * y), [n @ (x - before[1]) ** 2]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

        got = now_at.mapInArrow(run, "v binary").toArrow()["v"].to_pylist()
        out = np.sum([np.frombuffer(x, np.float64) for x in got], axis=0) if got else np.zeros(k * k + 2 * k + 1)
        return out[: k * k].reshape(k, k), out[k * k : k * k + k], out[k * k + k : -1], out[-1]

    def rebased() -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y, _ = replay(b.column(1).flatten().to_numpy().reshape(-1, k), tail, floor, (b.column(2).to_numpy(), b.column(3).to_numpy(), weight))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x), pa.array(y)], names=["tokens", "p", "x", "y"])

        return written(now_at.mapInArrow(run, "tokens long, p array<double>, x double, y double"))

    moves = np.zeros((0, k))
    gram, now, ahead, _ = job(True, tail)
    if not now.sum():
        return moves
    if budget is None:
        need = now / now.sum() / np.maximum(weights / weights.sum(), 1e-12) * floor
        budget = max(1.0, float(need.max()))
    target = budget * now.sum() * weights / weights.sum()
    # residual over the domain's size; one that hardly has tokens would else count so much that all rows are repeated for it
    scale = 1 / np.maximum.reduce([np.diag(gram), target * SCARCE, np.full(k, now.sum() * 1e-9)])
    step = safe = 1 / max(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale)).max(), 1e-12)
    best, off = np.inf, np.abs(now - target).max() / target.sum()
    for _ in range(steps):
        if off < TOLERANCE or abs(best - off) < TOLERANCE / 100:
            break
        if len(tail) >= rebase:
            now_at, weight, tail = rebased(), replay(np.zeros((0, k)), tail, 0.0, (np.zeros(0), np.zeros(0), weight))[2], np.zeros((0, k))
        move = (step * scale * (ahead - target))[None]
        _, x, y, moved = job(False, move)
        # rows at the floor don't move, so that steps may be longer than is safe for any move; one too long for the move it made is taken back
        bend = (scale * (x - ahead) ** 2).sum()
        if step > safe and step * bend > moved * (1 + 1e-9):
            step = max(safe, 0.9 * moved / bend)
            continue
        moves, tail, now, ahead, step = np.concatenate([moves, move]), np.concatenate([tail, move]), x, y, step * LONGER
        best, off = off, np.abs(now - target).max() / target.sum()
    if off > 10 * TOLERANCE:
        warnings.warn(f"after {len(moves)} steps the domains have {np.round(now / target.sum(), 4).tolist()} of the tokens wanted, not {np.round(target / target.sum(), 4).tolist()}", stacklevel=2)
    return moves


def plan(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, floor: float | np.ndarray = 0.0, budget: float | None = 1.0) -> tuple[DataFrame, np.ndarray]:
    """The written table of posteriors and the moves."""
    weights = WEIGHTS if weights is None else weights
    table = written(posteriors(docs, train(docs, labels, list(weights))))
    return table, fit_rates(table, np.array(list(weights.values())), floor, budget)


def rates(table: DataFrame, moves: np.ndarray, names: list[str], floor: float = 0.0) -> DataFrame:
    """(doc_id, h, tokens, p_<domain>..., rate) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(3).flatten().to_numpy().reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(p[:, c].copy()) for c in range(len(names))), pa.array(replay(p, moves, floor)[0])], names=schema.names)

    schema = T.StructType([*table.schema.fields[:3], *(T.StructField(f"p_{n}", T.DoubleType()) for n in names), T.StructField("rate", T.DoubleType())])
    return table.mapInArrow(run, schema)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, floor: float | np.ndarray = 0.0, budget: float | None = 1.0) -> DataFrame:
    """Every row of ``docs`` floor(rate) times, and once more with the probability of the rest, by a hash of doc_id and text."""
    weights = WEIGHTS if weights is None else weights
    at, k = _posterior(docs.sparkSession.sparkContext.broadcast(train(docs, labels, list(weights)))), len(weights)
    where, (u, n, p) = docs.columns.index("text"), unused(docs, "u", "tokens", "p")
    keyed = docs.select(*every(docs), F.xxhash64("doc_id", F.col("text").cast("string"), F.lit(17)).alias(u))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, post = at(b.column(where))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens), _lists(post)], names=[*b.schema.names, n, p])

    fields = [*keyed.schema.fields, T.StructField(n, T.LongType()), T.StructField(p, T.ArrayType(T.DoubleType()))]
    # written with the rows: texts are scored once, for the fit and for the choice
    scored = written(map_rows(keyed, score, T.StructType(fields)))
    moves = fit_rates(scored.select(F.col(n).alias("tokens"), F.col(p).alias("p")), np.array(list(weights.values())), floor, budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate = replay(b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, k), moves, floor)[0]
            chance = (b.column(b.num_columns - 3).to_numpy().view(np.uint64) >> np.uint64(11)) / 2.0**53
            times = np.floor(rate + 1e-9).astype(np.int64)
            times += chance < rate - times
            yield pa.RecordBatch.from_arrays(b.columns[:-3], names=b.schema.names[:-3]).take(pa.array(np.repeat(np.arange(b.num_rows), times)))

    return map_rows(scored, run, docs.schema)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    table, moves = plan(docs, labels)
    return rates(table, moves, list(WEIGHTS)).drop("h")

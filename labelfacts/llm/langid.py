"""Operator 2: language identification by interpolated Kneser-Ney character models.

For each language all its documents' character n-grams up to ORDER are counted (whole corpus, combined before the shuffle). Lower orders use
continuation counts; p(c|h) = max(n(hc) - D, 0) / n(h) + D * N1+(h) / n(h) * p(c|h'), down to a uniform distribution. Every n-gram is kept. The models of all
languages share one table per order, in files by the gram's remainder: the n-grams' hashes, sorted, with the finished log-probability in every
language beside them. Workers map the files, so that the model may be larger than memory and a known n-gram costs one look-up; an unknown one
backs off. The language with the least mean code length (bits a character) wins. Rejection is calibrated on all labelled texts, each measured by a
model without its half of them: a text is rejected if its code length is above nearly all of that language's own ones, allowing more to short texts.

Rows: a null or empty text is rejected with no language ("und") and null figures. Ties go to the language that comes first in the alphabet. Repeated
rows count as often as they stand there and are answered alike. Rows without a language don't train, but are answered. Without any labelled
row all are "und". Further columns aren't read.
"""

from __future__ import annotations

import io
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .shared import delete, folder

ORDER, BITS = 5, 12
#: N-grams in a file of the model, about.
SHARD = 250_000
#: Share of a language's texts that may be rejected, and the accuracy of that quantile (1 / ACCURACY of the rank).
ALPHA, ACCURACY = 0.002, 100_000
#: Parts of the labelled texts; each is measured by a model of the others.
FOLDS = 2
U = np.uint64


def _fold() -> np.ndarray:
    """Character to symbol below 2**BITS: lower case; white space is one symbol; digits too; what is above 4,095 shares symbols by hash. 0 is the start of a text."""
    out = np.arange(0x3000, dtype=np.uint16)
    for c in range(0x3000):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and ord(low) < 0x3000 else c
        if chr(c).isspace() or c < 32:
            out[c] = 32
        if chr(c).isdigit():
            out[c] = 48
    return np.where(out < 1 << BITS, out, 1 + out % 4095).astype(np.uint16)


_FOLD = _fold()


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, each row after ORDER - 1 start symbols, and where each row begins (one more at the end)."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.cumsum((data & 0xC0) != 0x80)
    cut = np.concatenate([[0], heads])[at]
    folded = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], 1 + codes % 4095).astype(U)
    pad = ORDER - 1
    begin = cut + pad * np.arange(len(cut))
    out = np.zeros(len(folded) + pad * (len(at) - 1), U)
    out[np.arange(len(folded)) + np.repeat(pad * np.arange(1, len(at)), np.diff(cut))] = folded
    return out, begin


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed ORDER-gram that ends at each character, and how many characters each row has."""
    s, begin = symbols(data, at)
    size = np.diff(begin) - (ORDER - 1)
    if len(s) < ORDER:
        return np.zeros(0, U), np.maximum(size, 0)
    key = np.zeros(len(s) - ORDER + 1, U)
    for j in range(ORDER):
        key = (key << U(BITS)) | s[j : j + len(key)]
    start = np.repeat(begin[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return key[start], size


def counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, lang, fold, n): how often each packed ORDER-gram stands in each language's documents of each fold; lang is the language's number."""
    number = {x: i for i, x in enumerate(languages)}

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def out(group: int, part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        key, n = part
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), group // FOLDS, np.int32)), pa.array(np.full(len(key), group % FOLDS, np.int32)), pa.array(n)], names=["gram", "lang", "fold", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for b in batches:
            own = np.array([number[x] for x in b.column(1).to_pylist()], np.int64) * FOLDS + b.column(2).to_numpy()
            for first, data, at in tx.pieces(b.column(0)):
                key, n = grams(data, at)
                group = np.repeat(own[first : first + len(n)], n)
                for g in np.unique(group):
                    held.setdefault(int(g), []).append(np.unique(key[group == g], return_counts=True))
                    size += len(held[int(g)][-1][0])
                if size > 4_000_000:
                    held = {g: [merge(parts)] for g, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > 2_000_000:  # leave it to the shuffle
                        for g, parts in held.items():
                            yield out(g, parts[0])
                        held, size = {}, 0
        for g, parts in held.items():
            yield out(g, merge(parts))

    own = docs.where(F.col("lang").isin(languages) & F.col("text").isNotNull()).select(F.col("text").cast("string"), "lang")
    return own.withColumn("fold", fold()).mapInArrow(run, "gram long, lang int, fold int, n long")


def fold() -> Column:
    """The fold of a text: equal texts are in one."""
    return F.pmod(F.xxhash64("text", F.lit(5)), F.lit(FOLDS)).cast("int")


class HashArray:
    """Sorted hashes with an index of where each leading-bit bucket begins: a look-up is a few comparisons."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray) -> None:
        self.hashes, self.begin = hashes, begin
        self.shift = U(64 - (len(begin) - 1).bit_length() + 1)

    @staticmethod
    def made(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the keys by hash, and the two arrays."""
        h = tx.mix(keys + U(1))
        order = np.argsort(h)
        bits = max(1, int(np.ceil(np.log2(max(len(keys), 2)))))
        begin = np.searchsorted(h[order] >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)
        return order, np.append(h[order], U(2**64 - 1)), begin

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the sorted order, -1 where it isn't."""
        h = tx.mix(keys + U(1))
        at = self.begin[h >> self.shift]
        found = self.hashes[at]
        out = np.where(found == h, at, -1)
        todo = np.flatnonzero(found < h)
        while len(todo):
            at_t = at[todo] + 1
            at[todo] = at_t
            found = self.hashes[at_t]
            want = h[todo]
            hit = found == want
            out[todo[hit]] = at_t[hit]
            todo = todo[(found < want) & (at_t < len(self.hashes) - 1)]
        return out


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    for name, array in arrays.items():
        held = io.BytesIO()
        np.save(held, array)
        with fs.open_output_stream(f"{path}/{name}.npy") as to:
            to.write(held.getbuffer())


def _load(uri: str, name: str) -> np.ndarray:
    """A mapped file: its pages are read as they are needed, and no worker holds a copy. From elsewhere than a file system it is fetched first."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    path = f"{path}/{name}.npy"
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.asarray(np.load(path, mmap_mode="r"))
    with tempfile.NamedTemporaryFile(suffix=".npy") as own, fs.open_input_stream(path) as source:
        shutil.copyfileobj(source, own)
        own.flush()
        return np.asarray(np.load(own.name, mmap_mode="r"))


class Shards:
    """Packed grams with rows of values, in files by the gram's remainder, which are mapped when they are first asked for."""

    def __init__(self, uri: str, count: int) -> None:
        self.uri, self.count, self.open = uri, count, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def _file(self, shard: int, name: str) -> np.ndarray | HashArray:
        if (shard, name) not in self.open:
            uri = f"{self.uri}/{shard}"
            self.open[shard, name] = HashArray(_load(uri, "hashes"), _load(uri, "begin")) if name == "index" else _load(uri, name)
        return self.open[shard, name]

    def get(self, keys: np.ndarray, *names: str) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """Which keys are known, and their rows of the named values (0 for the others); None if none is known."""
        known, out = np.zeros(len(keys), bool), [None for _ in names]
        shard = (keys % U(self.count)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.count + 1))
        for s in np.flatnonzero(np.diff(cut)):
            own = order[cut[s] : cut[s + 1]]
            at = self._file(s, "index").find(keys[own])
            own, at = own[at >= 0], at[at >= 0]
            if not len(own):
                continue
            known[own] = True
            for i, name in enumerate(names):
                rows = self._file(s, name)
                if out[i] is None:
                    out[i] = np.zeros((len(keys), rows.shape[1]), np.float32)
                out[i][own] = rows[at]
        return known, out

    def write(self, table: DataFrame, values: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> None:
        """Write the rows of ``table`` (gram, numbers ...): ``values`` makes the named values of the grams of one file."""
        shards = self.__class__(self.uri, self.count)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                key = t.column(0).to_numpy().view(U)
                made = values(key, np.stack([c.to_numpy() for c in t.columns[1:]], axis=1).astype(float))
            else:  # an empty file, so that look-ups needn't ask
                key, made = np.zeros(0, U), {}
            order, hashes, begin = HashArray.made(key)
            part = TaskContext.get().partitionId()
            _save(f"{shards.uri}/{part}", {"hashes": hashes, "begin": begin} | {k: v[order].astype(np.float32) for k, v in made.items()})
            yield pa.RecordBatch.from_arrays([pa.array([len(key)])], names=["n"])

        table.repartitionById(self.count, F.pmod("gram", F.lit(self.count)).cast("int")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


@dataclass
class Model:
    languages: list[str]
    grams: list[Shards]  # by order - 1: "full", and "held" of the models that leave out a fold each
    contexts: list[Shards]  # the same of log2 of the back-off weight of each context
    floor: dict[str, np.ndarray]  # log2 of the uniform probability in each
    limit: np.ndarray | None = None  # bits a character above which each language rejects


def _shards(rows: int) -> int:
    """A prime number of files of about SHARD grams."""
    n = max(1, -(-rows // SHARD))
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def build(counted: DataFrame, languages: list[str]) -> Model | None:
    """The interpolated model from all counts of ORDER-grams, order by order in Spark; every n-gram of every order is kept. Beside it, with columns
    of their own, stand the models of what is outside each fold, fold by fold: what a model of those documents alone would give."""
    spark, k, used = counted.sparkSession, len(languages), []
    sets = 1 + FOLDS
    names = [f"n{v}_{i}" for v in range(sets) for i in range(k)]

    def keep(df: DataFrame) -> DataFrame:
        used.append(folder(spark))
        df.write.parquet(used[-1])
        return spark.read.schema(df.schema).parquet(used[-1])

    def sums(v: int, i: int) -> Column:
        return F.sum(F.when((F.col("lang") == i) & (F.col("fold") != v - 1), F.col("n")).otherwise(0)).alias(f"n{v}_{i}")

    tables = [keep(counted.repartition("gram").groupBy("gram").agg(*(sums(v, i) for v in range(sets) for i in range(k))))]
    for order in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1)).alias("gram")
        tables.insert(0, keep(tables[0].groupBy(tail).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in names))))
    spread = lambda v, times: reduce(lambda x, y: x + y, (F.sum((F.col(f"n{v}_{i}") == times).cast("long")) for i in range(k)))
    seen = lambda v: F.sum(F.greatest(*(F.col(f"n{v}_{i}") for i in range(k)), F.lit(0)).cast("boolean").cast("long"))
    figures = [t.agg(F.count("*"), *(x for v in range(sets) for x in (spread(v, 1), spread(v, 2), seen(v)))).first() for t in tables]
    if not figures[0][0]:
        return None
    parts = lambda x: {"full": x[:, :k], "held": x[:, k:]}
    vocabulary = np.repeat([(figures[0][3 + 3 * v] or 0) + 1 for v in range(sets)], k).astype(float)
    floor = parts(-np.log2(vocabulary)[None])
    model = Model(languages, [], [], {name: x[0] for name, x in floor.items()})
    root = folder(spark)
    for order, (table, figure) in enumerate(zip(tables, figures), 1):
        ones, twos = (np.array([figure[j + 3 * v] or 0 for v in range(sets)]) for j in (1, 2))
        discount = np.repeat(np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95), k)
        grams = Shards(f"{root}/grams-{order}", _shards(figure[0]))
        contexts = Shards(f"{root}/contexts-{order}", _shards(figures[order - 2][0]) if order > 1 else 1)

        def weigh(key: np.ndarray, x: np.ndarray, discount: np.ndarray = discount) -> dict[str, np.ndarray]:
            total, kinds = x[:, : sets * k], x[:, sets * k :]
            return parts(np.log2(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1))) | {"total": total}

        def probability(key: np.ndarray, n: np.ndarray, order: int = order, discount: np.ndarray = discount, contexts: Shards = contexts, below: Shards | None = model.grams[-1] if order > 1 else None) -> dict[str, np.ndarray]:
            _, (full, held, total) = contexts.get(key >> U(BITS), "full", "held", "total")
            if below is None:
                base = 1 / vocabulary
            else:
                base = np.exp2(np.concatenate(below.get(key & U((1 << (BITS * (order - 1))) - 1), "full", "held")[1], axis=1).astype(float))
            p = np.maximum(n - discount, 0) / np.maximum(total, 1) + np.exp2(np.concatenate([full, held], axis=1).astype(float)) * base
            return parts(np.log2(p))

        head = F.shiftrightunsigned("gram", BITS).alias("gram")
        contexts.write(table.groupBy(head).agg(*(F.sum(c).alias(c) for c in names), *(F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in names)), weigh)
        grams.write(table, probability)
        model.grams.append(grams)
        model.contexts.append(contexts)
    for path in used:
        delete(spark, path)
    return model


def log2p(model: Model, key: np.ndarray, order: int = ORDER, which: str = "full") -> np.ndarray:
    """log2 p of each ORDER-gram's last character in each language."""
    known, (out,) = model.grams[order - 1].get(key, which)
    if out is None:
        out = np.zeros((len(key), len(model.floor[which])), np.float32)
    miss = np.flatnonzero(~known)
    if len(miss):
        lost = key[miss]
        _, (less,) = model.contexts[order - 1].get(lost >> U(BITS), which)
        rest = log2p(model, lost & U((1 << (BITS * (order - 1))) - 1), order - 1, which) if order > 1 else model.floor[which].astype(np.float32)
        out[miss] = rest if less is None else less + rest
    return out


def code_lengths(model: Model, column: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each row and bits a character in each language; or, with ``only``, in that one column of the models without a fold."""
    which = "full" if only is None else "held"
    n, bits = np.zeros(len(column), np.int64), np.zeros((len(column), len(model.languages) if only is None else 1))
    for first, data, at in tx.pieces(column, 1 << 18):
        key, size = grams(data, at)
        n[first : first + len(size)] = size
        full = np.flatnonzero(size)
        if len(full):
            cut = (np.cumsum(size) - size)[full]
            distinct, place = np.unique(key, return_inverse=True)
            p = log2p(model, distinct, which=which)
            p = p[place] if only is None else p[place, np.repeat(only[first : first + len(size)], size)][:, None]
            bits[first + full] = -np.add.reduceat(p, cut, axis=0, dtype=np.float64) / size[full, None]
    return n, bits


def train(docs: DataFrame) -> Model | None:
    """The model of the languages of ``docs``, with its limits: a quantile of each language's code lengths of all its texts, each by the model without its fold."""
    languages = sorted(r[0] for r in docs.where("lang is not null and text is not null").select("lang").distinct().collect())
    model = build(counts(docs, languages), languages) if languages else None
    if model is None:
        return None
    number = {x: i for i, x in enumerate(languages)}
    own = docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), "lang").withColumn("fold", fold())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            truth = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            n, bits = code_lengths(shared.value, b.column(0), b.column(2).to_numpy() * len(languages) + truth)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(truth[some]), pa.array((bits[:, 0] - _slack(n))[some])], names=["lang", "excess"])

    got = own.mapInArrow(run, "lang long, excess double").groupBy("lang").agg(F.percentile_approx("excess", 1 - ALPHA, ACCURACY)).collect()
    model.limit = np.full(len(languages), np.inf)  # a language whose texts are all empty
    for lang, limit in got:
        model.limit[lang] = limit * 1.05 + 0.05
    return model


def _slack(n: np.ndarray) -> np.ndarray:
    """Bits a character that a text of n characters may be above the limit: its mean scatters with the root of n."""
    return 6 / np.sqrt(np.maximum(n, 1))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, language, bits, margin, rejected) of every row; margin: bits a character to the second best language."""
    own = docs.select("doc_id", F.col("text").cast("string"))
    schema = T.StructType([own.schema["doc_id"], *T._parse_datatype_string("language string, bits double, margin double, rejected boolean").fields])
    if model is None:
        return own.select("doc_id", F.lit("und").alias("language"), F.lit(None).cast("double").alias("bits"), F.lit(None).cast("double").alias("margin"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for b in batches:
            n, bits = code_lengths(model, b.column(1))
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(n)), best]
            rest = np.partition(bits, 1, axis=1)[:, 1] - least if bits.shape[1] > 1 else np.zeros(len(n))
            reject = (n == 0) | (least > model.limit[best] + _slack(n))
            none = n == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[np.where(reject, len(names) - 1, best)], pa.string()), pa.array(least, mask=none), pa.array(rest, mask=none), pa.array(reject)], names=schema.names)

    return own.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder(spark)
    return identify(docs, train(docs))

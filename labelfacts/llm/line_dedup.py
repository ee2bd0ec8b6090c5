"""Operator 5: fuzzy line deduplication by MinHash.

Lines are what "\\n" parts. A line's shingles are its runs of SHINGLE lower-case characters, white space at the ends taken off; a shorter line is
one shingle. One-permutation hashing with rotation gives BINS minima, all of which are hashed to buckets as BANDS bands of ROWS: lines of
Jaccard similarity 0.7 share one with probability 0.988, of 0.8 with 0.9998. Buckets that have the same least line are verified as one group, by the exact Jaccard
similarity of their lines' shingle sets, breadth-first over what isn't reached yet, which yields the same components as all pairs of the group, those of its buckets among them; shingles are equal
if 44 bits of their hashes are. Distributed union-find joins the edges of all groups; of each component the first line (least doc_id, then place) stays. A bucket whose lines are all in one larger
bucket isn't verified by itself.
Bucket keys move packed, by as many ranges of them as spark.sql.shuffle.partitions; which line is in which bucket lies in mapped files, so that only lines that share a
bucket are moved with their text, and nothing is broadcast at any size. A line's text moves once for each group and each task that reads it.

Rows: a null text has no lines; blank lines are never compared. Equal lines are one component without being hashed to buckets. Ties are broken by
doc_id and place; repeated rows have the same doc_id and places: each of them is reported, and counts as the first if that place is. A null doc_id comes
last. A line of any length is one line. Further columns aren't read by ``line_groups``, and stay as they are in ``drop_lines``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .packed import Files, pack, pack_all, record, unpack
from .shared import col, components, delete, folder, unused, written

SHINGLE, BINS, BANDS, ROWS, JACCARD = 8, 64, 16, 4, 0.7
U = np.uint64
#: A line's hash and 48 bits of a bucket's key, which are enough as lines are verified; a bucket, a line in it, and how many there are; a bucket of so many lines that shares some with another.
SENT = np.dtype([("high", "u4"), ("low", "u2"), ("h", "i8")])
MEMBER = np.dtype([("key", "u8"), ("h", "i8"), ("size", "i4")])
PAIR = np.dtype([("key", "u8"), ("of", "u8"), ("size", "i4")])
#: A member with 32 bits of the least line of its bucket: buckets of one least line are verified as one group.
ROUTED = np.dtype([*MEMBER.descr, ("least", "u4")])
_MAX = U(2**64 - 1)
#: The mixed number of each character of the basic plane's first blocks: looked up instead of mixed anew.
MIXED = tx.mix(np.arange(1, 1 + (1 << 12), dtype=U))
#: Bytes of text that are hashed or verified at once: what is made of them stays in the processor's cache.
CHUNK = 1 << 17


def shingles(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle; rows are lines. A line of fewer than k characters gives one."""
    codes, cut = data, at
    if len(data) and data.max() > 127:
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        cut = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
    n = np.diff(cut)
    row = np.repeat(np.arange(len(n)), n)
    value = MIXED[codes] if not len(codes) or codes.max() < len(MIXED) else tx.mix(codes.astype(U) + U(1))
    sums = np.zeros(len(value) + 1, U)
    np.cumsum(value * tx._power("p", len(value)), out=sums[1:])
    whole = row[: 1 - k] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)
    h = sums[k:] - sums[:-k]
    h *= tx._power("i", len(value))[: len(h)]
    h, of = tx.mix(h[whole]), row[: len(whole)][whole]
    brief = np.flatnonzero((n > 0) & (n < k))
    if len(brief):
        short = tx.mix((sums[cut[brief + 1]] - sums[cut[brief]]) * tx._power("i", len(value) + 1)[cut[brief]] + n[brief].astype(U))
        return np.concatenate([h, short]), np.concatenate([of, brief])
    return h, of


def signatures(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x BINS minima; an empty bin takes the next full one's, changed by the way to it."""
    sig = np.full(rows * BINS, _MAX)
    np.minimum.at(sig, row * BINS + (h >> U(58)).astype(np.int64), h << U(6))
    sig = sig.reshape(rows, BINS)
    full = sig != _MAX
    if not full.all():
        where = np.where(np.concatenate([full, full], axis=1), np.arange(2 * BINS), 4 * BINS)
        ahead = np.minimum.accumulate(where[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        far = (ahead - np.arange(BINS)).astype(U)
        sig = np.take_along_axis(sig, ahead % BINS, axis=1) + far * U(0x9E3779B97F4A7C15)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS bucket keys."""
    out = np.empty((len(sig), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(sig), U(b + 1))
        for r in range(ROWS):
            key = tx.mix(key * U(0xD6E8FEB86659FD93) + sig[:, b * ROWS + r])
        out[:, b] = key
    return out


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, h) of every line that isn't blank; text without white space at its ends and in lower case, h its hash."""
    split = docs.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line", "text"))
    clean = split.select("doc_id", "line", F.lower(F.trim("text", F.lit(" \t\x0b\f\r"))).alias("text")).where("text <> ''")
    return clean.withColumn("h", F.xxhash64("text"))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
    for b in batches:
        h = b.column(0).to_numpy()
        _, one = np.unique(h, return_index=True)
        h, text = h[one], b.column(1).take(pa.array(one))
        for start, data, at in tx.pieces(text, CHUNK):
            rows = len(at) - 1
            key = bands(signatures(*shingles(data, at), rows)).ravel()
            yield (record(SENT, key >> U(32), (key >> U(16)) & U(0xFFFF), np.repeat(h[start : start + rows], BANDS)),)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches that hold whole groups of the first column, from sorted ones."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] != keys[-1] else 0
        if cut == 0 and (not held or held[-1].column(0)[-1].as_py() == keys[0]):
            held.append(b)
            continue
        whole = [*held, b.slice(0, cut)]
        held = [b.slice(cut)]
        yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shared_buckets(own: np.ndarray) -> np.ndarray:
    """Those members of buckets that hold more than one line, each once; key is then a hash of the bucket's lines, so that equal buckets of several bands are one."""
    key, h = (own["high"].astype(U) << U(32)) | (own["low"].astype(U) << U(16)), own["h"].copy()
    by = np.argsort(key)
    key, h = key[by], h[by]
    same = key[1:] == key[:-1]
    some = np.append(same, False)[: len(key)] | np.append(False, same)[: len(key)]  # most lines are alone in theirs
    key, h = key[some], h[some]
    by = np.lexsort((h, key))
    key, h = key[by], h[by]
    new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))[: len(key)]
    key, h = key[new], h[new]
    if not len(key):
        return np.zeros(0, MEMBER)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    lines_of = tx.mix(np.add.reduceat(tx.mix(h.view(U)), begin))
    many = np.repeat(size > 1, size)
    return record(MEMBER, np.repeat(lines_of, size)[many], h[many], np.repeat(size, size)[many])


def routed(met: np.ndarray) -> np.ndarray:
    """Members as ``shared_buckets`` gives them, each bucket's one after the other by line, with the least line of theirs."""
    begin = np.flatnonzero(np.append(True, met["key"][1:] != met["key"][:-1])[: len(met)])  # equal buckets have the same least line
    least = np.repeat(met["h"][begin], np.diff(np.append(begin, len(met))))
    return record(ROUTED, met["key"], met["h"], met["size"], least.view(U) >> U(32))


def overlaps(own: np.ndarray) -> np.ndarray:
    """For members sorted by line, each once: the pairs of a smaller and a larger bucket that a line is in."""
    out, key, h, size = [np.zeros(0, PAIR)], own["key"].copy(), own["h"].copy(), own["size"].copy()
    for step in range(1, BANDS):
        i = np.flatnonzero(h[step:] == h[:-step])
        if not len(i):
            break
        for x, y in ((i, i + step), (i + step, i)):
            less = size[x] < size[y]
            out.append(record(PAIR, key[x[less]], key[y[less]], size[x[less]]))
    return np.concatenate(out)


def contained(pairs: np.ndarray) -> np.ndarray:
    """The buckets, sorted, all of whose lines are in one larger bucket: it joins all that they would."""
    pairs = pairs[np.lexsort((pairs["of"], pairs["key"]))]
    begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    return np.unique(pairs["key"][begin][np.diff(np.append(begin, len(pairs))) == pairs["size"][begin]])


def shared_members(every: DataFrame, parts: int, members: Files, within: Files) -> None:
    """Save, by the line, the members of the buckets that hold more than one line, and the buckets that others contain. Neither lines nor buckets are gathered or broadcast for it."""

    def sent(keys: str, out: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([pack(out[keys].copy(), members.parts, out)]) if len(out) else pa.table({"part": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})

    def shared(_: tuple, rows: pa.Table) -> pa.Table:
        tx.give_back()
        return sent("h", routed(shared_buckets(unpack(rows["body"], SENT))))

    def save(part: tuple, rows: pa.Table) -> pa.Table:
        own = unpack(rows["body"], ROUTED)
        own = own[np.lexsort((own["key"], own["h"]))]
        own = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
        members.save(part[0].as_py(), own)
        return sent("key", overlaps(own))

    def drop(part: tuple, rows: pa.Table) -> pa.Table:
        out = contained(unpack(rows["body"], PAIR))
        within.save(part[0].as_py(), out)
        return pa.table({"n": pa.array([len(out)])})

    kind = "part int, body binary"
    packed = every.select("h", "text").mapInArrow(lambda b: pack_all(_buckets(b), lambda a: a["high"].astype(U) << U(32), parts), kind)
    steps = packed.groupBy("part").applyInArrow(shared, kind).groupBy("part").applyInArrow(save, kind).groupBy("part").applyInArrow(drop, "n long")
    steps.agg(F.sum("n")).collect()


def _members(members: Files, within: Files):
    """(group, h, text) of each line for each group, those buckets of one least line that no other bucket contains, that it is in, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            h, one = np.unique(b.column(0).to_numpy(), return_index=True)
            new = ~np.isin(h, seen)
            h, one = h[new], one[new]
            n, rows = members.rows(h, "h", ROUTED)
            seen = np.concatenate([seen, h[n > 0]])
            kept = ~within.has(rows["key"].copy())
            of = tx.distinct((np.repeat(np.arange(len(h)), n)[kept] << 32) | rows["least"][kept].astype(np.int64))
            line = of >> 32
            yield pa.RecordBatch.from_arrays([pa.array(of & 0xFFFFFFFF), pa.array(h[line]), b.column(1).take(pa.array(one[line]))], names=["key", "h", "text"])

    return run


#: Groups of up to so many lines are searched breadth-first side by side, one line of each at a time; larger ones by themselves.
SMALL = 64


def _shared_shingles(h: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every line; then, for those that several lines of a group have, the shingle's number and each of these lines."""
    group = np.repeat(np.arange(len(size)), size)
    own, of, value = row - begin[group[row]], group[row], h >> U(20)
    low = int(size.max() - 1).bit_length()
    if low + len(size).bit_length() <= 20:  # one key each: a plain sort is many times as fast as one by several
        key = np.sort((of.astype(U) << U(44 + low)) | (value << U(low)) | own.astype(U))
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        line = begin[(key >> U(44 + low)).astype(np.int64)] + (key & ((U(1) << U(low)) - U(1))).astype(np.int64)
        key >>= U(low)
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
    else:
        by = np.lexsort((own, value, of))
        line, value, of = row[by], value[by], of[by]
        new = np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))[: len(of)]
        one = new | np.append(True, line[1:] != line[:-1])[: len(line)]
        line, new = line[one], new[one]
    count = np.bincount(line, minlength=len(group))
    several = ~(new & np.append(new[1:], True)[: len(new)])
    return count, np.cumsum(new[several]) - 1, line[several]


def _component(shingle: np.ndarray, line: np.ndarray, count: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Edges between lines of at least that similarity, enough to join the components of all of them. ``shingle`` is sorted."""
    of_shingle = np.append(np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])[: len(shingle)]), len(shingle))
    by = np.argsort(line, kind="stable")
    of_line, shingles_of = np.searchsorted(line[by], np.arange(len(count) + 1)), (shingle - shingle[:1])[by]
    left, a, c = np.ones(len(count), bool), [], []
    for seed in range(len(count)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue and left.any():
            at = queue.pop()
            own = shingles_of[of_line[at] : of_line[at + 1]]
            lo = of_shingle[own]
            n = of_shingle[own + 1] - lo
            common = np.bincount(line[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(count))
            near = np.flatnonzero(left & (common >= least * (count + count[at] - common)))
            left[near] = False
            queue.extend(near.tolist())
            a += [at] * len(near)
            c += near.tolist()
    return a, c


def _components(shingle: np.ndarray, line: np.ndarray, count: np.ndarray, group: np.ndarray, least: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same for many groups at once: a round compares one line of each with all that aren't reached yet."""
    left, queued, a, c = np.zeros(len(count), bool), np.zeros(len(count), bool), [], []
    left[line] = True  # the others share nothing
    while len(line):
        lines = np.flatnonzero(left | queued)
        lines = lines[np.lexsort((left[lines], group[lines]))]  # of each group one that was reached, if there is any
        seeds = lines[np.append(True, group[lines[1:]] != group[lines[:-1]])]
        left[seeds] = queued[seeds] = False
        seed = np.full(group[-1] + 1, -1)
        seed[group[seeds]] = seeds
        seed = seed[group]
        hit = np.zeros(shingle[-1] + 1, bool)
        hit[shingle[seed[line] == line]] = True
        common = np.bincount(line[hit[shingle]], minlength=len(count))
        near = np.flatnonzero(left & (common > 0) & (common >= least * (count + count[seed] - common)))
        left[near], queued[near] = False, True
        a.append(seed[near])
        c.append(near)
        some = np.zeros(group[-1] + 1, bool)
        some[group[left]] = True
        queued &= some[group]  # a group is over when all its lines are reached
        kept = (left | queued)[line]
        shingle, line = shingle[kept], line[kept]
    return a, c


def _edges(data: np.ndarray, at: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the lines of groups of so many lines each, one after the other, enough to join the components of each group."""
    begin, group = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    count, shingle, line = _shared_shingles(*shingles(data, at), begin, size)
    large = size > SMALL
    of, none = group[line], np.zeros(0, np.int64)
    x, y = _components(shingle[~large[of]], line[~large[of]], count, group, least)
    a, c = [none, *x], [none, *y]
    for k in np.flatnonzero(large):
        lo, hi = np.searchsorted(of, [k, k + 1])
        x, y = _component(shingle[lo:hi], line[lo:hi] - begin[k], count[begin[k] : begin[k] + size[k]], least)
        a.append(begin[k] + np.array(x, np.int64))
        c.append(begin[k] + np.array(y, np.int64))
    return np.concatenate(a), np.concatenate(c)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups_of(batches):
            key, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))  # the same line comes from several tasks
            b, key, h = b.filter(pa.array(new)), key[new], h[new]
            begin = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for _, data, at in tx.pieces(b.column(2), 1 << 62):
                first = 0
                while first < len(begin) - 1:
                    end = max(first + 1, int(np.searchsorted(at[begin], at[begin[first]] + CHUNK, "right")) - 1)
                    lo, hi = begin[first], begin[end]
                    x, y = _edges(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], np.diff(begin[first : end + 1]), least)
                    yield pa.RecordBatch.from_arrays([pa.array(h[lo + x]), pa.array(h[lo + y])], names=["a", "b"])
                    first = end

    return run


def line_groups(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """(doc_id, line, first_doc_id, first_line, keep) of every line whose component holds more than one line or place."""
    every = written(lines(docs))
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members, within = (Files(f"{path}/{x}", 1 + parts // 8) for x in ("members", "within"))
    try:
        shared_members(every, parts, members, within)
        rows = every.select("h", "text").mapInArrow(_members(members, within), "key long, h long, text string").repartition("key").sortWithinPartitions("key", "h")
        linked = components(rows.mapInArrow(_verify(least), "a long, b long"))
    finally:
        delete(spark, path)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "line")
    rooted = every.select("doc_id", "line", "h").join(linked.withColumnRenamed("node", "h"), "h", "left").select("doc_id", "line", F.coalesce("root", "h").alias("g"))
    first = rooted.groupBy("g").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("g", F.col("f.doc_id").alias("first_doc_id"), F.col("f.line").alias("first_line"))
    return rooted.join(first, "g").select("doc_id", "line", "first_doc_id", "first_line", F.expr("doc_id <=> first_doc_id and line = first_line").alias("keep"))


def drop_lines(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """``docs`` with the text of each row less the lines that repeat an earlier one; all other columns as they are."""
    gone = line_groups(docs, least).where("not keep").groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    id_, lines_ = unused(docs, "id", "lines")
    gone = gone.select(F.col("doc_id").alias(id_), F.col("lines").alias(lines_))
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains(lines_, i), F.lit(False)))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    return joined.select(*(F.when(F.col(lines_).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else col(c) for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

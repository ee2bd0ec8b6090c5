"""Operator 9: substring deduplication over a log-structured fingerprint index.

Words are what white space parts. Every window of WINDOW words has a rolling hash; winnowing (Schleimer et al. 2003) keeps the least
of each SPREAD neighbouring hashes, so that two texts that share WINDOW + SPREAD - 1 words in a row keep a common one.
The index is a log of immutable runs, sorted by hash: the distinct hashes of a batch of documents, with the first place of each, are merge-joined with every run.
Each window that is in an earlier document (by batch, then by a hash of doc_id and text, then by place) is a match with the first such one, and the
batch's own new hashes become a run. A window whose hash stands in different surroundings is put in once more, by all the runs of MIN_WORDS words around it,
as further hashes of the same log: else a first holder of the window alone would hide a longer passage that two later documents share. FAN runs of one level are merged into one of the next
(compaction). The log lives in a folder with a manifest and can be opened again for a later batch. Matches that follow each other at
one shift are joined, verified and lengthened on the words of both documents, and spans of MIN_WORDS words at least are reported. For that the words around the
places that others repeat, which are few, are put in mapped files, and each document is read once more and compared with them: no passage is joined with its copies.

Hashes are parted into ranges by their leading bits, as many as spark.sql.shuffle.partitions. A range takes no part in another, so one task carries its range
through all batches; hashes, matches and places move packed, a binary value for each range, and what many tasks look up lies in mapped files. A range has to fit in
the memory of a task: some 24 bytes for each of its windows, a few times over.

Rows: a null, empty or short text has no window. Equal doc_ids with different texts are different documents; repeated rows (equal doc_id and
text) are one document. A passage that repeats inside one document repeats its first place there. Ties can't arise: places are ordered.
A null doc_id takes part like any other. Further columns aren't read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .packed import Files, pack, pack_all, record, unpack
from .shared import delete, folder, small, written

WINDOW, SPREAD, MIN_WORDS = 24, 24, 47
BATCHES, FAN = 5, 4
U = np.uint64
#: A hash and where it first stands; a match; a passage of a document, documents as unsigned numbers; one that repeats another.
ENTRY = np.dtype([("fp", "u8"), ("doc", "i8"), ("place", "i4")])
HIT = np.dtype([("doc", "i8"), ("doc0", "i8"), ("place", "i4"), ("place0", "i4"), ("size", "i4")])
PLACE = np.dtype([("doc", "u8"), ("a", "i4"), ("b", "i4")])
FOUND = np.dtype([("doc", "u8"), ("doc0", "u8"), ("a", "i4"), ("b", "i4"), ("a0", "i4"), ("b0", "i4")])
#: Documents whose passages are looked up at once.
ROWS = 256


def winnow(hashes: np.ndarray, rows: np.ndarray, spread: int) -> np.ndarray:
    """Indexes of the windows that are the least (the last of equals) of some ``spread`` neighbours in their row; of fewer windows, the least."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    size = np.diff(np.append(begin, n))
    # rows are parted by spread - 1 greatest values, so that one sliding minimum serves all and none crosses a row
    at = np.arange(n) + np.repeat(np.arange(len(size)) * (spread - 1), size)
    line = np.full(n + len(size) * (spread - 1), U(2**64 - 1))
    line[at] = hashes
    index = np.arange(len(line))
    best, step = index.copy(), 1
    while step < spread:  # doubling: best of step values becomes best of 2 * step, the last of equals
        move = min(step, spread - step)
        left, right = best[: len(best) - move], best[move:]
        best = np.where(line[left] < line[right], left, right)
        step += move
    # a window of neighbours counts if it begins in a row and lies in it whole, or the row is shorter than that
    whole = np.minimum(size, spread)
    room = np.repeat(size - whole, size) >= (np.arange(n) - np.repeat(begin, size))
    chosen = np.unique(best[np.minimum(at[room], len(best) - 1)])
    back = np.full(len(line), -1)
    back[at] = np.arange(n)
    chosen = back[chosen]
    return chosen[chosen >= 0]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, last, row = tx.spans(data, at)
    return first, last, row, tx.hash_spans(data, first, last)


def _documents(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("text is not null").select(F.xxhash64("doc_id", text).alias("doc"), "doc_id", text.alias("text"))


def _chosen(doc: np.ndarray, texts: pa.Array, window: int, spread: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each piece of the texts: the document of each row, row and hash of each word, hash and first word of each chosen window."""
    for start, data, at in tx.pieces(texts):
        _, _, row, word = _words(data, at)
        h, begin = tx.windows(word, row, window)
        if len(h):
            k = winnow(h, row[begin], spread)
            # the least hashes are small ones, and would all be in the first ranges; mixing is one to one
            yield doc[start : start + len(at) - 1], row, word, tx.mix(h[k]), begin[k]


def windows(docs: DataFrame, parts: int, window: int, spread: int, reach: int) -> DataFrame:
    """The chosen windows, packed: entries whose place counts words, and for each a hash of up to ``reach`` words on either side and the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for doc, row, word, h, begin in _chosen(b.column(0).to_numpy(), b.column(1), window, spread):
                own = row[begin]
                place = begin - np.searchsorted(row, own)
                sums = np.append(U(0), np.cumsum(word * tx._power("p", len(word))))
                left, right = np.minimum(place, reach), np.minimum(np.searchsorted(row, own, "right") - begin - window, reach)
                x = begin - left
                around = tx.mix((sums[begin + window + right] - sums[x]) * tx._power("i", len(word) + 1)[x] + (left * (reach + 1) + right).astype(U))
                yield record(ENTRY, h, doc[own], place), around

    return _documents(docs).select("doc", "text").mapInArrow(lambda b: pack_all(run(b), "fp", parts), "part int, body binary, around binary")


def differing(packed: DataFrame, entries: Files, differ: Files) -> None:
    """Save the windows by ranges, and the fingerprints that stand in different surroundings."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tx.give_back()
        own, around = unpack(rows["body"], ENTRY), unpack(rows["around"], U)
        by = np.argsort(own["fp"])
        own, around = own[by], around[by]
        fp = own["fp"].copy()
        begin = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
        entries.save(key[0].as_py(), own)
        differ.save(key[0].as_py(), fp[begin][np.minimum.reduceat(around, begin) != np.maximum.reduceat(around, begin)])
        return pa.table({"n": pa.array([len(own)])})

    packed.groupBy("part").applyInArrow(run, "n long").agg(F.sum("n")).collect()


def wide(docs: DataFrame, differ: Files, parts: int, window: int, spread: int, reach: int) -> DataFrame:
    """All runs of window + reach words around the windows whose fingerprint stands in different surroundings, packed: there the
    first holder may share no more than the window, while a later one shares a long passage; a whole run has the same first holder for all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
        for b in batches:
            for doc, row, word, chosen, place in _chosen(b.column(0).to_numpy(), b.column(1), window, spread):
                place = place[differ.has(chosen)]
                h, begin = tx.windows(word, row, window + reach)
                if not len(h) or not len(place):
                    continue
                # the runs that hold a wanted window begin at most ``reach`` words before it
                change = np.zeros(len(word) + 1, np.int64)
                np.add.at(change, np.maximum(place - reach, np.searchsorted(row, row[place])), 1)
                np.add.at(change, place + 1, -1)
                k = np.flatnonzero(np.cumsum(change)[begin] > 0)
                own = row[begin[k]]
                yield (record(ENTRY, h[k], doc[own], begin[k] - np.searchsorted(row, own)),)

    return _documents(docs).select("doc", "text").mapInArrow(lambda b: pack_all(run(b), "fp", parts), "part int, body binary")


def merged(own: np.ndarray, size: np.ndarray, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join a batch's entries, each of so many words, with all runs: the new hashes with their first place, sorted, and what repeats an earlier place."""
    by = np.argsort(own["fp"])
    own, size = own[by], size[by]
    fp, doc, place = (own[c].copy() for c in ENTRY.names)
    if not len(fp):
        return np.zeros(0, ENTRY), np.zeros(0, HIT)
    head = np.append(True, fp[1:] != fp[:-1])
    begin, group = np.flatnonzero(head), np.cumsum(head) - 1
    fps, doc0 = fp[begin], np.minimum.reduceat(doc, begin)
    place0 = np.minimum.reduceat(np.where(doc == doc0[group], place, np.int32(2**31 - 1)), begin)
    known = np.zeros(len(fps), bool)
    for run in runs:
        if len(run):
            held = np.ascontiguousarray(run["fp"])
            at = np.minimum(np.searchsorted(held, fps), len(held) - 1)
            same = np.flatnonzero(held[at] == fps)
            known[same], doc0[same], place0[same] = True, run["doc"][at[same]], run["place"][at[same]]
    new = record(ENTRY, fps[~known], doc0[~known], place0[~known])
    doc0, place0 = doc0[group], place0[group]
    again = (doc != doc0) | (place != place0)
    return new, record(HIT, *(x[again] for x in (doc, doc0, place, place0, size)))


def compacted(runs: list[np.ndarray]) -> np.ndarray:
    """One run of several; a fingerprint is in one row of one of them."""
    out = np.concatenate([np.zeros(0, ENTRY), *runs])
    return out[np.argsort(out["fp"])]


class Log:
    """The fingerprint index: immutable runs of (fp, doc, place), parted into ranges of fp and sorted by it, a fingerprint in one row of one run.

    All of it is in the folder ``root``: a folder a run, with a file for each range, and a manifest of which runs are on which level, rewritten after each call of ``put``."""

    def __init__(self, spark: SparkSession, root: str | None = None, fan: int = FAN) -> None:
        self.spark, self.fan, self.root = spark, fan, root or folder(spark)
        self.parts, self.levels = int(spark.conf.get("spark.sql.shuffle.partitions")), [[]]

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Log:
        """The log that an earlier session left in ``root``."""
        path, fs = cls._file(spark, f"{root}/manifest.json")
        with_lines = spark.sparkContext._jvm.scala.io.Source.fromInputStream(fs.open(path), "UTF-8")
        held = json.loads(with_lines.mkString())
        with_lines.close()
        log = cls(spark, root, held["fan"])
        log.parts, log.levels = held["parts"], held["levels"]
        return log

    @staticmethod
    def _file(spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _save(self) -> None:
        path, fs = self._file(self.spark, f"{self.root}/manifest.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"fan": self.fan, "parts": self.parts, "levels": self.levels}).encode()))
        out.close()

    def drop(self) -> None:
        """Remove all runs; what was found has to be written elsewhere before."""
        delete(self.spark, self.root)

    def close(self) -> None:
        """The log holds nothing but its folder, which stays."""

    def _steps(self, batches: int) -> tuple[list[tuple[str, list[str]]], list[list[str]]]:
        """What every range goes through for so many batches: (run, []) for a batch's own, (run, runs) for a compaction; and the levels then."""
        steps, levels = [], [list(x) for x in self.levels]
        for _ in range(batches):
            steps.append((f"run_{uuid.uuid4().hex}", []))
            levels[0].append(steps[-1][0])
            level = 0
            while len(levels[level]) >= self.fan:
                steps.append((f"run_{uuid.uuid4().hex}", levels[level]))
                levels[level] = []
                if len(levels) == level + 1:
                    levels.append([])
                levels[level + 1].append(steps[-1][0])
                level += 1
        return steps, levels

    def put_packed(self, packed: DataFrame, size: int, batches: int = 1, entries: Files | None = None, of: int = 0) -> DataFrame:
        """Put in entries of ``size`` words, packed by ranges, and those of the files ``entries``, of ``of`` words: batch after batch, by the hash of their document.
        Returns the written stretches of what repeats an earlier place. Runs that a later batch of the same call compacts are never saved."""
        (steps, levels), fan, parts, root = self._steps(batches), self.fan, self.parts, self.root
        old = [x for level in self.levels for x in level]
        stay = {x for level in levels for x in level}

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            part = key[0].as_py()
            tx.give_back()
            more = [] if entries is None else [Files(entries.uri, parts).part(part, ENTRY)]
            own = np.concatenate([unpack(rows["body"], ENTRY), *more])
            sizes = np.full(len(own), size, np.int32)
            sizes[len(own) - sum(map(len, more)) :] = of
            number = ((own["doc"].view(U) >> U(40)) % U(batches)).astype(np.int32)
            runs = {x: Files(f"{root}/{x}", parts).part(part, ENTRY) for x in old}
            hits, batch = [], 0
            for name, merge in steps:
                if merge:
                    runs[name] = compacted([runs.pop(x) for x in merge])
                else:
                    mine = number == batch
                    runs[name], found = merged(own[mine], sizes[mine], list(runs.values()))
                    hits.append(found)
                    batch += 1
            for name in stay.difference(old):
                Files(f"{root}/{name}", parts).save(part, runs[name])
            found = np.concatenate(hits)
            return pa.Table.from_batches([pack(found["doc"].copy(), parts, found)]) if len(found) else pa.table({"part": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})

        every = packed.unionAll(self.spark.range(parts).selectExpr("cast(id as int) part", "cast(null as binary) body"))
        out = every.groupBy("part").applyInArrow(run, "part int, body binary")
        return self._done(out, levels, old)

    def _done(self, hits: DataFrame, levels: list[list[str]], old: list[str]) -> DataFrame:
        """Run it, then note the new levels and remove the runs that are merged into others."""
        out = written(hits)
        self.levels = levels
        self._save()
        for name in set(old).difference(x for level in levels for x in level):
            delete(self.spark, f"{self.root}/{name}")
        return out

    def put(self, batch: DataFrame) -> DataFrame:
        """Merge-join the hashes of (fp, doc, place) with all runs; new ones, with their first place, become a run. Returns (doc, place, doc0, place0): what repeats."""
        parts = self.parts

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
            for b in batches:
                yield (record(ENTRY, b.column(0).to_numpy().view(U), b.column(1).to_numpy(), b.column(2).to_numpy()),)

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = unpack(b.column(1), HIT)
                yield pa.RecordBatch.from_arrays([pa.array(x[c].copy()) for c in ("doc", "place", "doc0", "place0")], names=["doc", "place", "doc0", "place0"])

        packed = batch.select("fp", "doc", "place").mapInArrow(lambda b: pack_all(records(b), "fp", parts), "part int, body binary")
        return self.put_packed(packed, 0).mapInArrow(flat, "doc long, place int, doc0 long, place0 int")


def matches(docs: DataFrame, found: Files, batches: int = BATCHES, window: int = WINDOW, spread: int = SPREAD, min_words: int = MIN_WORDS, fan: int = FAN) -> DataFrame:
    """Save the stretches of the windows that repeat an earlier one, all batches put through the index one after the other; the written places that they repeat.
    The index is dropped then."""
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    reach = max(min_words, window + spread - 1) - window
    log = Log(spark, fan=fan)
    entries, differ = Files(f"{path}/entries", log.parts), Files(f"{path}/differ", log.parts)
    try:
        differing(windows(docs, log.parts, window, spread, reach), entries, differ)
        hits = log.put_packed(wide(docs, differ.joined(spark, U), log.parts, window, spread, reach), window + reach, batches, entries, window)
        return written(stretches(hits, found))
    finally:
        log.drop()
        delete(spark, path)


def stretches(hits: DataFrame, found: Files) -> DataFrame:
    """Save (doc, doc0, a, b, a0, b0): packed matches of ``size`` words at one shift that overlap or touch, joined; word places, b excluded. Returns the places in doc0, packed."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tx.give_back()
        own = unpack(rows["body"], HIT)
        doc, doc0, place, place0, size = (own[c].copy() for c in HIT.names)
        doc, doc0, shift = doc.view(U), doc0.view(U), place - place0
        by = np.lexsort((place, shift, doc0, doc))
        doc, doc0, place, shift, end = doc[by], doc0[by], place[by].astype(np.int64), shift[by], (place + size)[by].astype(np.int64)
        other = np.append(True, (doc[1:] != doc[:-1]) | (doc0[1:] != doc0[:-1]) | (shift[1:] != shift[:-1]))
        base = (np.cumsum(other) - 1) << 32
        far = np.maximum.accumulate(base + end)  # the farthest end so far; a later group's are all beyond an earlier one's
        first = np.flatnonzero(other | (base + place > np.append(-1, far[:-1])))
        last = np.append(first[1:], len(doc)) - 1
        a, b, s = place[first].astype(np.int32), (far[last] - base[last]).astype(np.int32), shift[first]
        found.save(key[0].as_py(), record(FOUND, doc[first], doc0[first], a, b, a - s, b - s))
        firsts = _once(record(PLACE, doc0[first], a - s, b - s))
        return pa.Table.from_batches([pack(firsts["doc"].copy(), found.parts, firsts)])

    return hits.groupBy("part").applyInArrow(run, "part int, body binary")


def _once(own: np.ndarray) -> np.ndarray:
    """Records by document and place, one of each."""
    own = own[np.lexsort((own["b"], own["a"], own["doc"]))]
    differs = np.zeros(max(len(own) - 1, 0), bool)
    for c in PLACE.names:
        differs |= own[c][1:] != own[c][:-1]
    return own[np.append(True, differs)[: len(own)]]


def save_places(packed: DataFrame, files: Files, kind: np.dtype) -> Files:
    """Packed records of places saved, each place once, by document; in few files."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tx.give_back()
        own = _once(unpack(rows["body"], kind))
        files.save(key[0].as_py(), own)
        return pa.table({"n": pa.array([len(own)])})

    packed.groupBy("part").applyInArrow(run, "n long").agg(F.sum("n")).collect()
    return files.joined(packed.sparkSession, kind)


def _asked(batches: Iterator[pa.RecordBatch], asked: Files, kind: np.dtype) -> Iterator[tuple]:
    """The rows of (doc, doc_id, text) that have records in the files, by pieces of their texts: rows, bytes, row offsets; the records and the row of each."""
    for part in batches:
        n, held = asked.rows(part.column(0).to_numpy().view(U), "doc", kind)
        part, n = part.filter(pa.array(n > 0)), n[n > 0]
        begin = np.append(0, np.cumsum(n))
        for s in range(0, part.num_rows, ROWS):
            b = part.slice(s, ROWS)
            for start, data, at in tx.pieces(b.column(2)):
                i, rows = s + start, len(at) - 1
                yield b.slice(start, rows), data, at, held[begin[i] : begin[i + rows]], np.repeat(np.arange(rows), n[i : i + rows])


def context(reach: int) -> np.dtype:
    """A passage with the hash of its words, how many of up to ``reach`` words there are on either side, and 32 bits of each one's hash, from the near to the far."""
    return np.dtype([("doc", "u8"), ("a", "i4"), ("b", "i4"), ("body", "u8"), ("left", "i4"), ("right", "i4"), ("near", "u4", (2, reach))])


def _contexts(doc: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, word: np.ndarray, own: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of words a..b of the given rows, and the first word of each one's row. A chance equality of near words (1 in 4e9) would move an edge by a word;
    the passage itself is compared by 64 bits."""
    head, tail = np.searchsorted(row, own), np.searchsorted(row, own, "right")
    x, y = head + a, head + b
    sums = np.append(U(0), np.cumsum(tx.mix(word ^ U(0x452821E638D01377)) * tx._power("p", len(word))))
    full = np.zeros(len(x), context(reach))
    full["doc"], full["a"], full["b"] = doc, a, b
    full["body"] = tx.mix((sums[y] - sums[x]) * tx._power("i", len(word) + 1)[x])
    full["left"], full["right"] = np.minimum(x - head, reach), np.minimum(tail - y, reach)
    half, step = (word >> U(32)).astype(np.uint32), np.arange(reach)
    full["near"][:, 0] = half[np.maximum(x[:, None] - 1 - step, 0)]
    full["near"][:, 1] = half[np.minimum(y[:, None] + step, len(word) - 1)]
    return full, head


def contexts(own: DataFrame, firsts: Files, reach: int) -> DataFrame:
    """The contexts of the files' places, packed by document, and rows of (doc, doc_id) of these documents."""
    kind, parts = own.schema["doc_id"].dataType.simpleString(), firsts.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at, here, rows in _asked(batches, firsts, PLACE):
            _, _, row, word = _words(data, at)
            full, _ = _contexts(here["doc"], here["a"], here["b"], row, word, rows, reach)
            packed = pack(full["doc"].copy(), parts, full)
            m, n = packed.num_rows, b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x, pa.nulls(n, x.type)]) for x in packed.columns] + [pa.concat_arrays([pa.nulls(m, x.type), x]) for x in b.columns[:2]], names=["part", "body", "doc", "doc_id"]
            )

    return own.select("doc", "doc_id", "text").mapInArrow(run, f"part int, body binary, doc long, doc_id {kind}")


def islands(own: DataFrame, found: Files, theirs: Files, reach: int, min_words: int) -> DataFrame:
    """(doc, doc_id, a, start, end, words, doc0): stretches verified and lengthened on the words of both documents, those that overlap or touch joined,
    with each document that one of least a repeats."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at, here, of in _asked(batches, found, FOUND):
            known, there = theirs.at(here["doc0"].copy(), here["a0"], here["b0"], context(reach))
            first, last, row, word = _words(data, at)
            full, head = _contexts(here["doc"], here["a"], here["b"], row, word, of, reach)
            k = np.flatnonzero(known & (full["body"] == there["body"]))
            if not len(k):
                continue
            here, there, full, head, of = here[k], there[k], full[k], head[k], of[k]
            same = full["near"] == there["near"]
            for i, side in enumerate(("left", "right")):
                same[:, i] &= np.arange(reach) < np.minimum(full[side], there[side])[:, None]
            left, right = np.logical_and.accumulate(same, axis=2).sum(axis=2).T
            a, b = here["a"] - left, here["b"] + right
            chars = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
            zero = chars[at[of]]
            start, end, doc0 = chars[first[head + a]] - zero, chars[last[head + b - 1]] - zero, here["doc0"]
            by = np.lexsort((doc0, a, of))
            a, b, start, end, doc0, of = (x[by] for x in (a, b, start, end, doc0, of))
            base = of.astype(np.int64) << 32
            far = np.maximum.accumulate(base + b)
            begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (base[1:] + a[1:] > far[:-1])))
            size = np.diff(np.append(begin, len(a)))
            start, end, low = np.minimum.reduceat(start, begin), np.maximum.reduceat(end, begin), a[begin]
            words = np.maximum.reduceat(b, begin) - low
            n = np.repeat(np.arange(len(begin)), size)
            keep = np.flatnonzero((a == low[n]) & (words[n] >= min_words) & np.append(True, (n[1:] != n[:-1]) | (doc0[1:] != doc0[:-1])))
            n, take = n[keep], pa.array(of[keep])
            ints = [pa.array(x[n].astype(np.int32)) for x in (low, start, end, words)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), *ints, pa.array(doc0[keep].view(np.int64))], names=["doc", "doc_id", "a", "start", "end", "words", "doc0"])

    return own.select("doc", "doc_id", "text").mapInArrow(run, f"doc long, doc_id {kind}, a int, start int, end int, words int, doc0 long")


def _distinct(docs: DataFrame) -> DataFrame:
    """The documents, each once: only rows that stand there more than once are moved to make them one."""
    every = _documents(docs)
    again = written(every.groupBy("doc").count().where("count > 1").select("doc"))
    if again.isEmpty():
        return every
    again = small(again)
    return every.join(again, "doc", "left_anti").unionAll(every.join(again, "doc", "left_semi").dropDuplicates(["doc"]))


def spans(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, spread: int = SPREAD, min_words: int = MIN_WORDS, fan: int = FAN) -> DataFrame:
    """(doc_id, start, end, words, first_doc_id) of the repeated passages: text[start:end] in characters, and the document that its first part repeats.

    The contexts of places that others repeat are few, and lie in mapped files; a document is read once more, compared with them and its passages joined on the spot."""
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = Files(f"{path}/found", parts)
    try:
        firsts = save_places(matches(docs, found, batches, window, spread, min_words, fan), Files(f"{path}/firsts", parts), PLACE)
        found, own = found.joined(spark, FOUND), _distinct(docs)
        cut = written(contexts(own, firsts, spread))
        theirs = save_places(cut.where("part is not null").select("part", "body"), Files(f"{path}/theirs", parts), context(spread))
        joined = written(islands(own, found, theirs, spread, min_words))
    finally:
        delete(spark, path)
    ids = cut.where("doc is not null").select(F.col("doc").alias("doc0"), F.col("doc_id").alias("first_doc_id"))
    each = joined.join(ids, "doc0").groupBy("doc", "a").agg(*(F.first(c).alias(c) for c in ("doc_id", "start", "end", "words")), F.min_by("first_doc_id", F.struct(F.col("first_doc_id").isNull(), "first_doc_id")).alias("first_doc_id"))
    return each.select("doc_id", "start", "end", "words", "first_doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

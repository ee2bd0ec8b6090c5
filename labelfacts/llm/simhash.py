"""Operator 3: near-duplicates by SimHash and multi-index hashing.

A document's 128-bit fingerprint is the sign pattern of the sum of its hash signs of its distinct bare lower-case words, weighted by the fourth
root of the words' inverse document frequency over all documents and by the logarithm of their number. Fingerprints are cut into six segments.
Every fingerprint enumerates the Hamming ball of radius 1 of each segment, in the table and as a query alike, so two that differ by at most 2 bits
in some segment meet under a common key; by the pigeonhole principle those are all pairs within 6 * 3 - 1 = 17 bits. Pairs that meet are verified by
complete distance, each counted under one key only. Groups are the connected components of verified pairs; the least doc_id of each stays.

Keys that share a segment's leading bits form a cell, and a fingerprint is sent once to each cell that its balls reach (1 + leading bits a segment) and
enumerates its keys there. A cell with more than CELL fingerprints is cut into blocks, and each pair of blocks is a task of its own: no
cell has to fit in one, and no pair is lost. Pairs aren't written: a task yields a spanning forest of its verified pairs, and each fingerprint's number of links.

Rows: equal texts have equal fingerprints and are one group. A null text, or one without a word, is in no group and stays.
Repeated rows, and rows that share a doc_id, are decided by their texts; ties go to the least doc_id, then the least other orderable
columns. Further columns are carried along as they are, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import components, every, folder, keep_first, roots, small, text_keys, unused, written

RADIUS = 17
WIDTHS = (22, 22, 21, 21, 21, 21)
DF_BITS = 20
#: Fingerprints of a cell that one task compares; and the number a cell should have by choice of its leading bits.
CELL, FILL = 1_000_000, 60_000
U = np.uint64


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed word bucket occurs, over all documents: an array of fixed size, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << DF_BITS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, data, at in tx.pieces(b.column(0)):
                low = tx.lower(data)
                first, last, row = tx.spans(low, at, tx.PUNCT)
                bucket = (tx.hash_spans(low, first, last) >> U(64 - DF_BITS)).astype(np.int64)
                key = tx.distinct((row << DF_BITS) | bucket)
                total += np.bincount(key & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << DF_BITS) + 1, np.int64)
    df[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return df[:-1], int(df[-1])


def _weighted(data: np.ndarray, at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct word of each row, by row."""
    low = tx.lower(data)
    first, last, row = tx.spans(low, at, tx.PUNCT)
    new = np.append(True, row[1:] != row[:-1])[: len(row)]
    rows = row[new]
    # number of the row and the leading bits of the hash in one key, so that a plain sort brings equal words of a row together
    key = np.sort(((np.cumsum(new) - 1).astype(U) << U(46)) | (tx.hash_spans(low, first, last) >> U(18)))
    one = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times, word = np.diff(np.append(one, len(key))), key[one] & U((1 << 46) - 1)
    return rows[(key[one] >> U(46)).astype(np.int64)], word, (idf[(word >> U(46 - DF_BITS)).astype(np.int64)] * np.log2(1 + times)).astype(np.float32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(h, g, hi, lo, rows, least) of each distinct text with a word in it: its two hashes, its print, the number of rows and their least doc_id."""
    df, n = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1) + 0.05).clip(0.05) ** 0.25).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    texts = docs.where("text is not null").select("doc_id", *(k.alias(n) for k, n in zip(text_keys(F.col("text").cast("string")), "hg")), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for b in batches:
            for start, data, at in tx.pieces(b.column(3), 1 << 18):
                row, word, weight = _weighted(data, at, idf)
                if not len(row):
                    continue
                bits = np.stack([tx.mix(word ^ U(0x243F6A8885A308D3)), tx.mix(word ^ U(0x13198A2E03707344))], axis=1)
                rows, begin = np.unique(row, return_index=True)
                sums = np.empty((len(rows), 128), np.float32)
                for s in range(0, len(rows), 64):  # few rows at a time: the sign matrix stays in the cache
                    lo, hi = begin[s], begin[s + 64] if s + 64 < len(rows) else len(row)
                    part = np.zeros((min(64, len(rows) - s), 128), np.float32)
                    for c in range(lo, hi, 16384):  # a long text is summed in parts
                        d = min(hi, c + 16384)
                        signs = np.unpackbits(bits[c:d].view(np.uint8), axis=1).astype(np.float32)
                        signs *= 2 * weight[c:d, None]
                        signs -= weight[c:d, None]
                        own = row[c:d]
                        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        part[np.searchsorted(rows[s : s + 64], own[cut])] += np.add.reduceat(signs, cut, axis=0)
                    sums[s : s + 64] = part
                code = np.packbits(sums > 0, axis=1).view(np.int64)
                take = pa.array(start + rows)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(code[:, 0].copy()), pa.array(code[:, 1].copy())], names=["doc_id", "h", "g", "hi", "lo"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    made = texts.mapInArrow(run, f"doc_id {kind}, h long, g long, hi long, lo long")
    return made.groupBy("h", "g", "hi", "lo").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))


def _segments(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """The six segments of each fingerprint: three of each half."""
    out = []
    for half, w in enumerate((hi.view(U), lo.view(U))):
        shift = 0
        for width in WIDTHS[half::2]:
            out.append((w >> U(shift)) & U((1 << width) - 1))
            shift += width
    return out


_WIDTHS = [*WIDTHS[0::2], *WIDTHS[1::2]]


def _cells(hi: np.ndarray, lo: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, cell) for every cell that a fingerprint's balls reach: its own leading bits in each segment, or one of them turned."""
    cells = []
    for i, (value, width) in enumerate(zip(_segments(hi, lo), _WIDTHS)):
        own = (value >> U(width - lead)).astype(np.int64)
        turned = np.append(0, 1 << np.arange(lead))
        cells.append((own[:, None] ^ turned) + (i << lead))
    cells = np.concatenate(cells, axis=1)
    return np.repeat(np.arange(len(hi)), cells.shape[1]), cells.ravel()


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _keys(value: np.ndarray, width: int, lead: int, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, key) of the ball members that lie in the cell."""
    inside = (value >> U(width - lead)).astype(np.int64) == cell
    own, other = np.flatnonzero(inside), np.flatnonzero(~inside)
    masks = np.append(U(0), U(1) << np.arange(width - lead, dtype=U))
    mine = (value[own][:, None] ^ masks).ravel()
    rest = (U(cell) << U(width - lead)) | (value[other] & U((1 << (width - lead)) - 1))
    return np.concatenate([np.repeat(own, len(masks)), other]), np.concatenate([mine, rest])


def _near(hi: np.ndarray, lo: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(hi[i] ^ hi[j]) + np.bitwise_count(lo[i] ^ lo[j]) <= radius


def verified(hi: np.ndarray, lo: np.ndarray, block: np.ndarray, segment: int, lead: int, cell: int, unit: tuple[int, int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs within the radius that meet in this cell and unit, each pair of fingerprints in one place of all cells, units and keys."""
    parts = _segments(hi, lo)
    value, width = parts[segment], _WIDTHS[segment]
    own, key = _keys(value, width, lead, cell)
    by = np.argsort(key, kind="stable")
    own, key = own[by], key[by]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))

    def here(i: np.ndarray, j: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(_near(hi, lo, i, j, radius))
        i, j, key = i[near], j[near], key[near]
        first, second = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
        ok = (first == unit[0]) & (second == unit[1])
        for earlier in parts[:segment]:
            ok &= np.bitwise_count(earlier[i] ^ earlier[j]) > 2
        differ = value[i] ^ value[j]
        low = differ & (~differ + U(1))
        ok &= np.minimum(value[i] ^ low, value[j] ^ low) == key  # of the keys that both have
        return i[ok], j[ok]

    most = min(64, int(size.max(initial=0)))
    for step in range(1, most):  # small buckets: all pairs that are step apart, all buckets at once
        some = (size > step) & (size <= 64)
        n = size[some] - step
        for part in np.array_split(np.arange(len(n)), max(1, int(n.sum()) >> 21)):
            x = np.repeat(begin[some][part], n[part]) + _ramp(n[part])
            yield here(own[x], own[x + step], key[x])
    for k in np.flatnonzero(size > 64):
        members = own[begin[k] : begin[k] + size[k]]
        rows = max(1, (1 << 21) // len(members))
        for s in range(0, len(members), rows):
            x = np.arange(s, min(s + rows, len(members)))
            n = len(members) - 1 - x
            yield here(members[np.repeat(x, n)], members[np.repeat(x, n) + 1 + _ramp(n)], np.full(n.sum(), key[begin[k]]))


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL, fill: int = FILL) -> DataFrame:
    """(a, b, n) of prints (id, hi, lo, texts): edges a-b that join the components of all pairs within the radius, and parts n of the
    number of other prints' texts that a is linked with; b may be a."""
    count = prints.count()
    lead = int(np.clip(np.ceil(np.log2(max(count, 1) / fill)), 2, 14))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6 << lead, np.int64)
        for b in batches:
            total += np.bincount(_cells(b.column(0).to_numpy(), b.column(1).to_numpy(), lead)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    blocks = np.ones(6 << lead, np.int64)
    for r in prints.select("hi", "lo").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > cell).collect():
        blocks[r["cell"]] = -(-r["n"] // cell)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 8192):
                part = b.slice(s, 8192)
                ids, hi, lo, texts = (part.column(i).to_numpy() for i in range(4))
                row, to = _cells(hi, lo, lead)
                n = blocks[to]
                block = (tx.mix(ids.view(U))[row] % n.astype(U)).astype(np.int64)
                copy = np.repeat(np.arange(len(row)), n)
                other = _ramp(n)
                row, to, block = row[copy], to[copy], block[copy]
                unit = np.minimum(block, other) * (1 << 24) + np.maximum(block, other)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (to, unit, block, ids[row], hi[row], lo[row], texts[row])], names=["cell", "unit", "block", "id", "hi", "lo", "texts"])

    def compare(group: pa.Table) -> pa.Table:
        to, unit = group["cell"][0].as_py(), group["unit"][0].as_py()
        block, ids, hi, lo, texts = (group[c].to_numpy() for c in ("block", "id", "hi", "lo", "texts"))
        n, held, size = np.zeros(len(ids), np.int64), [], 0

        def forest() -> list[tuple[np.ndarray, np.ndarray]]:
            nodes, root = roots(*(np.concatenate(x) for x in zip(*held)))
            return [(nodes[nodes != root], root[nodes != root])]

        for i, j in verified(hi, lo, block, to >> lead, lead, to & ((1 << lead) - 1), (unit >> 24, unit & ((1 << 24) - 1)), radius):
            if not len(i):
                continue
            n += np.bincount(i, texts[j], len(ids)).astype(np.int64) + np.bincount(j, texts[i], len(ids)).astype(np.int64)
            held.append((i, j))
            size += len(i)
            if size > 4_000_000:
                held = forest()
                size = len(held[0][0])
        root = np.arange(len(ids))
        if held:
            node, to_root = forest()[0]
            root[node] = to_root
        some = np.flatnonzero(n)
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[root[some]]), "n": pa.array(n[some])})

    rows = prints.select("id", "hi", "lo", "texts").mapInArrow(sent, "cell long, unit long, block long, id long, hi long, lo long, texts long")
    return rows.groupBy("cell", "unit").applyInArrow(compare, "a long, b long, n long")


def groups(docs: DataFrame, radius: int = RADIUS, cell: int = CELL, fill: int = FILL) -> DataFrame:
    """(h, g, root, group_id, links, size) of every text with a word: its group, the least doc_id and number of rows of that, and with how many
    other texts it is within the radius."""
    if radius > 17:
        raise ValueError("radius-1 balls of six segments find all pairs up to distance 17 only")
    folder(docs.sparkSession)
    texts = written(fingerprints(docs))
    prints = written(texts.groupBy("hi", "lo").agg(F.count("*").alias("texts")).withColumn("id", F.monotonically_increasing_id()))
    edges = written(links(prints, radius, cell, fill))
    linked = components(edges.select("a", "b"))
    number = edges.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = prints.join(linked.withColumnRenamed("node", "id"), "id", "left").join(number, "id", "left")
    named = named.select("hi", "lo", F.coalesce("root", "id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("texts") - 1).alias("links"))
    rooted = written(texts.join(named, ["hi", "lo"]).drop("hi", "lo"))
    group = rooted.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("rows").alias("size"))
    return written(rooted.drop("rows", "least").join(small(written(group)), "root"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, links, keep) of every row: the least doc_id of its group, and the number of other texts within the radius of its own."""
    own = docs.select("doc_id", *(k.alias(n) for k, n in zip(text_keys(F.col("text").cast("string")), "hg")))
    found = groups(docs, radius).select("h", "g", "group_id", "links")
    return own.join(small(found), ["h", "g"], "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")).withColumn("keep", F.expr("doc_id <=> group_id"))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """One row of each group, all columns as they are. ``most``: bytes of the table of groups up to which no row is moved."""
    h, g, h2, g2, root = unused(docs, "h", "g", "h2", "g2", "root")
    table = small(written(groups(docs, radius).where("size > 1").select(F.col("h").alias(h2), F.col("g").alias(g2), F.col("root").alias(root))), most)
    keyed = docs.select(*every(docs), *(k.alias(n) for k, n in zip(text_keys(F.col("text").cast("string")), (h, g))))
    marked = keyed.join(table, (F.col(h) == F.col(h2)) & (F.col(g) == F.col(g2)), "left")
    return keep_first(marked.select(*every(docs), F.col(root)), root, docs.columns, most)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Records of fixed width parted into ranges of a 64-bit key: packed, a binary value for each range, on their way, and in mapped files where many tasks look them up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .langid import _load, _save
from .shared import delete

U = np.uint64
#: Records that a task gathers before it parts them.
HELD = 200_000
#: Files that a look-up from any task goes through at most.
FILES = 16


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges each key is in, by its leading bits."""
    return (((keys.view(U) >> U(32)) * U(parts)) >> U(32)).astype(np.int32)


def record(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, c in zip(kind.names, columns):
        out[name] = c
    return out


def pack(keys: np.ndarray, parts: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """(part, a binary value of each array): for each range of keys its rows."""
    part = range_of(keys, parts)
    by = np.argsort(part, kind="stable")
    there, begin = np.unique(part[by], return_index=True)
    cut = np.append(begin, len(part))
    body = [pa.BinaryArray.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((cut * a.itemsize).astype(np.int32)), pa.py_buffer(a[by].tobytes())]) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(there), *body], names=["part", "body", "around"][: 1 + len(body)])


def pack_all(records: Iterator[tuple[np.ndarray, ...]], key: str | Callable[[np.ndarray], np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Records gathered, HELD or so at a time, and packed by the ranges of the first ones' key, a field or made of them."""
    of = key if callable(key) else lambda a: a[key].copy()
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[0])
        if size >= HELD:
            arrays = [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
            yield pack(of(arrays[0]), parts, *arrays)
            del arrays, r
            tx.give_back()
    if size:
        arrays = [np.concatenate(x) for x in zip(*held)]
        yield pack(of(arrays[0]), parts, *arrays)


def unpack(column: pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid)])


class Files:
    """Sorted records in files of the shared folder, one for each range of keys, or for ``group`` ranges; mapped when they are first asked for. A range without a file is empty."""

    def __init__(self, uri: str, parts: int, group: int = 1) -> None:
        self.uri, self.parts, self.group, self.open = uri, parts, group, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def save(self, part: int, records: np.ndarray) -> None:
        if len(records):
            _save(self.uri, {str(part): records})

    def part(self, part: int, kind: np.dtype | type) -> np.ndarray:
        if part not in self.open:
            try:
                self.open[part] = _load(self.uri, str(part))
            except FileNotFoundError:
                self.open[part] = np.zeros(0, kind)
        return self.open[part]

    def joined(self, spark: SparkSession, kind: np.dtype | type, most: int = FILES) -> Files:
        """The same records in at most ``most`` files: what a look-up costs besides its keys doesn't grow with the ranges. Files are copied one after the other,
        so records have to be sorted as unsigned keys are. The files they come from are removed."""
        group = -(-self.parts // most)
        out, count = Files(f"{self.uri}_joined", self.parts, group), -(-self.parts // group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g in b.column(0).to_pylist():
                    own = [self.part(p, kind) for p in range(g * group, min((g + 1) * group, self.parts))]
                    out._join(g, own, np.dtype(kind))
                    yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, own))])], names=["n"])

        spark.range(0, count, 1, count).mapInArrow(run, "n long").agg(F.sum("n")).collect()
        delete(spark, self.uri)
        return out

    def _join(self, name: int, arrays: list[np.ndarray], kind: np.dtype) -> None:
        fs, path = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}.npy") as to:
            np.lib.format.write_array_header_1_0(to, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (sum(map(len, arrays)),)})
            for a in arrays:
                for s in range(0, len(a), HELD):
                    to.write(a[s : s + HELD].tobytes())

    def ranges(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each file whose ranges have some of the keys, and which."""
        part = range_of(keys, self.parts) // self.group
        by = np.lexsort((keys, part))
        there, begin = np.unique(part[by], return_index=True)
        yield from zip(there.tolist(), np.split(by, begin[1:]))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for p, at in self.ranges(keys):
            held = self.part(p, U)
            if len(held):
                out[at] = held[np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)] == keys[at]
        return out

    def rows(self, keys: np.ndarray, field: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """How many records each key has, and they, key by key. Files that are sorted by that field, as a signed number."""
        n, met = np.zeros(len(keys), np.int64), []
        for p, at in self.ranges(keys):
            held = self.part(p, kind)
            lo = np.searchsorted(held[field], keys[at])
            n[at] = np.searchsorted(held[field], keys[at], "right") - lo
            some = n[at] > 0
            met.append((held, at[some], lo[some]))
        begin, out = np.cumsum(n) - n, np.empty(n.sum(), kind)
        for held, at, lo in met:
            m = n[at]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(begin[at], m) + step] = held[np.repeat(lo, m) + step]
        return n, out

    def at(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """Which (doc, a, b) there are, and their records (zeros for the others). Files that are sorted by these fields, doc as an unsigned number."""
        known, out, want = np.zeros(len(keys), bool), np.zeros(len(keys), kind), _pair(a, b)
        for p, at in self.ranges(keys):
            held = self.part(p, kind)
            if not len(held):
                continue
            lo, hi = np.searchsorted(held["doc"], keys[at]), np.searchsorted(held["doc"], keys[at], "right")
            end = hi
            while (open_ := lo < hi).any():  # bisection inside each document
                mid = np.minimum((lo + hi) >> 1, len(held) - 1)
                less = _pair(held["a"][mid], held["b"][mid]) < want[at]
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            there = np.minimum(lo, len(held) - 1)
            same = (lo < end) & (_pair(held["a"][there], held["b"][there]) == want[at])
            known[at[same]], out[at[same]] = True, held[there[same]]
        return known, out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b

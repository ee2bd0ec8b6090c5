"""Whole groups in large Arrow batches: a kernel sees many groups at once, so that no group costs a call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows a kernel gets at once, at least, where there are as many; the last group comes whole, whatever its size.
ROWS = 1 << 16

Kernel = Callable[[pa.Table, np.ndarray], pa.Table]


def by_group(table: DataFrame, keys: list[str], order: list[str | Column], of: Kernel, schema: StructType | str) -> DataFrame:
    """``of`` over the rows of whole groups, sorted by keys and order: it takes them and the positions at which groups begin.

    A row's number in its group marks the beginnings; its window brings a group together, and costs no shuffle where it is together already."""
    mark = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def made() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from of(t.drop_columns(["_row"]), np.flatnonzero(t["_row"].to_numpy() == 1)).combine_chunks().to_batches()

        for b in batches:
            starts = np.flatnonzero(b["_row"].to_numpy() == 1)
            if rows >= ROWS and len(starts):
                held.append(b.slice(0, starts[-1]))
                yield from made()
                held, rows, b = [], 0, b.slice(starts[-1])
            held.append(b)
            rows += b.num_rows
        if rows:
            yield from made()

    return table.withColumn("_row", mark).mapInArrow(run, schema)


def sizes(starts: np.ndarray, rows: int) -> np.ndarray:
    return np.diff(np.append(starts, rows))

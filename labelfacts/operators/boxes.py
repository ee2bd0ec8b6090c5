"""Operators over word boxes: image_id, seq (dense from 0 in each image), text, left, top, width, height.

Every join and window has image_id as its key, so one shuffle by image serves a whole chain.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType, _parse_datatype_string

from ..functions import text as ft
from ..vocabulary import FOOTERS, LINE_FUDGE, OVERLAP, SMALL_HEIGHT
from . import words as wd
from .grouped import by_group, sizes

def _image() -> WindowSpec:
    return Window.partitionBy("image_id")


def _order() -> WindowSpec:
    return _image().orderBy("seq")


def renumber(boxes: DataFrame, *order: str) -> DataFrame:
    return boxes.withColumn("seq", (F.row_number().over(_image().orderBy(*(order or ("seq",)))) - 1).cast("int"))


def drop_blank(boxes: DataFrame) -> DataFrame:
    return renumber(boxes.where(~F.col("text").isin("", " ")))


def drop_rows(boxes: DataFrame, rows: DataFrame) -> DataFrame:
    """Without the (image_id, seq) of ``rows``, renumbered."""
    return renumber(boxes.join(rows.select("image_id", "seq"), ["image_id", "seq"], "left_anti"))


def ngram(size: int, column: str = "text", over=None) -> Column:
    """The next ``size`` words joined by blanks, fewer at the end, without trailing blanks."""
    return F.rtrim(F.array_join(F.collect_list(column).over((over or _order()).rowsBetween(0, size - 1)), " "))


def drop_below(boxes: DataFrame, phrases: list[str] = FOOTERS, most: int = 1) -> DataFrame:
    """Rows before the first hit of any phrase (at most ``most`` edits) in their image."""
    sizes = sorted({p.count(" ") + 1 for p in phrases})
    hit = F.lit(False)
    for n in sizes:
        for p in phrases:
            if p.count(" ") + 1 == n:
                hit = hit | ft.within(F.lower(F.col(f"_n{n}")), F.lit(p), most)
    marked = boxes.withColumns({f"_n{n}": ngram(n) for n in sizes}).withColumn("_hit", F.min(F.when(hit, F.col("seq"))).over(_image()))
    return marked.where("_hit is null or seq < _hit").select(boxes.columns)


def calories_from(boxes: DataFrame, line: str = "line") -> DataFrame:
    """On each line, all from consecutive words "calories", "from" on is dropped."""
    by = Window.partitionBy("image_id", line)
    hit = (F.col("text") == "calories") & (F.lead("text").over(by.orderBy("seq")) == "from")
    return renumber(boxes.withColumn("_h", hit).withColumn("_f", F.min(F.when(F.col("_h"), F.col("seq"))).over(by)).where("_f is null or seq < _f").select(boxes.columns))


def split_items(boxes: DataFrame) -> DataFrame:
    """Words parted into numbers and the rest, or at slashes; the width is shared by length, cut to whole pixels."""
    # the source's columns get names of their own: inside a lambda, "text" would be taken for the new column
    share = lambda p: F.floor(F.length(p) / F.col("_n") * F.col("_w")).cast("int")
    source = boxes.withColumns({"_p": ft.parts("text"), "_n": F.length("text"), "_w": F.col("width")}).withColumn("_s", F.transform("_p", share))
    exploded = source.select("*", F.posexplode("_p").alias("_i", "_t"))
    shifted = F.aggregate(F.slice("_s", F.lit(1), F.col("_i")), F.lit(0), lambda a, s: a + s)
    made = exploded.withColumns({"text": F.col("_t"), "left": F.col("left") + shifted, "width": F.get("_s", F.col("_i"))})
    return renumber(made, "seq", "_i").select(boxes.columns)


def in_one_pass(boxes: DataFrame, of: Callable[[wd.Words], pa.Table], schema: StructType) -> DataFrame:
    """What ``of`` makes of the words of whole images. Instead of boxes, printed lines (image_id, line_no, text) may be given, which spares the words' own shuffle."""
    return by_group(boxes, ["image_id"], ["seq" if "seq" in boxes.columns else "line_no"], lambda t, starts: of(wd.Words(t, starts)), schema)


def stepped(boxes: DataFrame, *steps: Callable[[wd.Words], None]) -> DataFrame:
    """boxes, or printed lines, after kernels of operators.words, all in one pass over each image: boxes."""

    def of(w: wd.Words) -> pa.Table:
        for step in steps:
            step(w)
        return w.boxes()

    if "seq" not in boxes.columns:
        return in_one_pass(boxes, of, StructType([boxes.schema["image_id"], *_parse_datatype_string("seq int, text string, `left` int, top int, width int, height int")]))
    boxes = boxes.withColumn("seq", F.col("seq").cast("int"))
    return in_one_pass(boxes, of, boxes.schema)


def clean_up(boxes: DataFrame) -> DataFrame:
    """The whole clean-up chain in its fixed order; lines are told by ``top``."""
    return stepped(boxes, wd.clean_up)


def on_line(i: str = "i", j: str = "j", fudge: int = LINE_FUDGE, small: int = SMALL_HEIGHT) -> Column:
    """Whether i's centre lies inside j's height; a very low j takes i's height. Not symmetric."""
    h = F.when(F.col(f"{j}.height") <= small, F.col(f"{i}.height")).otherwise(F.col(f"{j}.height"))
    centre = F.col(f"{i}.top") + F.col(f"{i}.height") / 2
    return (centre > F.col(f"{j}.top") - fudge) & (centre < F.col(f"{j}.top") + h + fudge)


def overlapping(i: str = "i", j: str = "j", fraction: float = OVERLAP) -> Column:
    """Whether the heights of i and j overlap, but where both spans across are within the fraction of j's height."""
    ti, hi, tj, hj = (F.col(f"{x}.{n}") for x, n in ((i, "top"), (i, "height"), (j, "top"), (j, "height")))
    return ((ti + hi - tj > fraction * hj) & (ti < tj + hj)) | ((tj + hj - ti > fraction * hj) & (tj < ti + hi))


def same_line(seeds: DataFrame, boxes: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs (image_id, i, j, dist) of words j on the line of seed i; dist is the difference of their lefts."""
    pairs = seeds.alias("i").join(boxes.alias("j"), (F.col("i.image_id") == F.col("j.image_id")) & (on_line() if condition is None else condition))
    return pairs.select(F.col("i.image_id").alias("image_id"), F.col("i.seq").alias("i"), F.col("j.seq").alias("j"), (F.col("j.left") - F.col("i.left")).alias("dist"))


def right_of(pairs: DataFrame, side: str = "right") -> DataFrame:
    return pairs.where("dist >= 0") if side == "right" else pairs.where("dist <= 0") if side == "left" else pairs


def centre_box(boxes: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1): whole-pixel bounds of the words' centres."""
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    return boxes.groupBy("image_id").agg(*(f(v).cast("int").alias(n) for n, f, v in (("x0", F.min, x), ("y0", F.min, y), ("x1", F.max, x), ("y1", F.max, y))))


def trimmed(boxes: DataFrame, least: int = 3, trim_left: int = 5, trim_top: int = 5) -> DataFrame:
    """Boxes of words of at least so many letters, shrunk on all sides, of at least 1 x 1."""
    own = boxes.where(F.length("text") >= least)
    shrink = {"left": F.col("left") + trim_left, "top": F.col("top") + trim_top, "width": F.greatest(F.col("width") - 2 * trim_left, F.lit(1)), "height": F.greatest(F.col("height") - 2 * trim_top, F.lit(1))}
    return own.withColumns(shrink)


def merge_vitamins(boxes: DataFrame) -> DataFrame:
    """"vitamin" or "vitamine" and its letter become one word; so do "b" and a number after it."""
    return stepped(boxes, wd.merge_vitamins)


def merge_vocabulary(boxes: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Neighbouring words that make a word of the vocabulary when written without a blank become one item, with the blank; from left to right, each word once.

    In a run of overlapping pairs every second one is merged."""
    return stepped(boxes, lambda w: wd.merge_vocabulary(w, vocabulary))


def greedy_lines(boxes: DataFrame, fudge: int = LINE_FUDGE, small: int = SMALL_HEIGHT) -> DataFrame:
    """boxes with ``line``: the first word not on a line yet seeds the next one and takes all words on its line, those seen before too."""

    def number(t: pa.Table, starts: np.ndarray) -> pa.Table:
        line = number_lines(t["top"].to_numpy(), t["height"].to_numpy(), starts, fudge, small)
        return t.append_column("line", pa.array(line, pa.int32()))

    return by_group(boxes, ["image_id"], ["seq"], number, StructType([*boxes.schema.fields, StructField("line", IntegerType())]))


def number_lines(top: np.ndarray, height: np.ndarray, starts: np.ndarray, fudge: int, small: int) -> np.ndarray:
    """The lines of words of many images, which begin at ``starts``: a step for each line, in all images that have as many."""
    image = np.repeat(np.arange(len(starts)), sizes(starts, len(top)))
    line, rows, n = np.full(len(top), -1), np.arange(len(top)), 0
    while len(rows):
        own = image[rows]
        free = rows[line[rows] < 0]
        seed = free[np.diff(image[free], prepend=-1) > 0]
        rows = rows[np.isin(own, image[seed])] if len(seed) < own[-1] + 1 else rows
        if not len(seed):
            break
        line[seed] = n
        i = np.repeat(seed, np.unique(image[rows], return_counts=True)[1])
        centre = top[i] + height[i] / 2
        line[rows[(top[rows] - fudge < centre) & (centre < top[rows] + np.where(height[rows] <= small, height[i], height[rows]) + fudge)]] = n
        n += 1
    return line

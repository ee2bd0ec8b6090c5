"""Barcode digits from text annotations (file, pos, text, box); pos 0 is the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.boxes import contains_box, direction, union_box
from ..functions.text import digits


def _order() -> WindowSpec:
    return Window.partitionBy("file").orderBy("pos")


def full_code(text: str | Column) -> Column:
    """The code of a text with exactly twelve digits."""
    d = digits(text)
    return F.when(F.length(d) == 12, d)


def first_is_whole(annotations: DataFrame) -> DataFrame:
    """(file, whole): whether the first annotation's box holds all others; false where there are none."""
    by = annotations.withColumn("_b", F.first(F.when(F.col("pos") == 0, F.col("box")), ignorenulls=True).over(Window.partitionBy("file")))
    return by.groupBy("file").agg((F.coalesce(F.bool_and(F.when(F.col("pos") > 0, contains_box(F.col("_b"), F.col("box")))), F.lit(False))).alias("whole"))


def middle(annotations: DataFrame) -> DataFrame:
    """(file, middle, box): the first annotation behind the whole text with ten digits, or with five before another of five; the last one alone doesn't count."""
    t = annotations.where("pos > 0").withColumn("d", digits("text")).withColumns({"_d": F.lead("d").over(_order()), "_b": F.lead("box").over(_order())})
    ten = (F.length("d") == 10) & F.col("_b").isNotNull()
    pair = (F.length("d") == 5) & (F.length("_d") == 5)
    code, box = F.when(ten, F.col("d")).when(pair, F.concat("d", "_d")), F.when(ten, F.col("box")).otherwise(union_box(F.col("box"), F.col("_b")))
    return t.where(ten | pair).groupBy("file").agg(F.min_by(F.struct(code.alias("middle"), box.alias("box")), "pos").alias("m")).select("file", "m.*")


def sides(annotations: DataFrame, middles: DataFrame) -> DataFrame:
    """(file, left, right): the single digit strictly left and right of the middle, where all that lie there agree."""
    t = annotations.where("pos > 0").withColumn("d", digits("text")).where(F.length("d") == 1).join(middles.select("file", F.col("box").alias("_m")), "file")
    t = t.withColumn("w", direction(F.col("_m"), F.col("box")))
    one = lambda side: F.when(F.min(F.when(F.col("w") == side, F.col("d"))) == F.max(F.when(F.col("w") == side, F.col("d"))), F.min(F.when(F.col("w") == side, F.col("d"))))
    return t.groupBy("file").agg(one("left").alias("left"), one("right").alias("right"))


def codes(annotations: DataFrame, read_sides: DataFrame | None = None) -> DataFrame:
    """(file, upc): the whole text's twelve digits where its box holds all others; else left, middle and right, "?" for a side that isn't known.
    read_sides: (file, left, right) that a second recognition of the bars' sides gave."""
    whole = annotations.where("pos = 0").select("file", full_code("text").alias("_full")).join(first_is_whole(annotations), "file").select("file", F.when(F.col("whole"), F.col("_full")).alias("_full"))
    mid = middle(annotations)
    t = whole.join(mid, "file", "left").join(sides(annotations, mid), "file", "left")
    left, right = F.col("left"), F.col("right")
    if read_sides is not None:
        t = t.join(read_sides.select("file", F.col("left").alias("_l"), F.col("right").alias("_r")), "file", "left")
        left, right = F.coalesce("left", "_l"), F.coalesce("right", "_r")
    return t.select("file", F.coalesce("_full", F.concat(F.coalesce(left, F.lit("?")), F.col("middle"), F.coalesce(right, F.lit("?")))).alias("upc"))


def first_cutoff(passes: DataFrame) -> DataFrame:
    """(file, upc) of passes (file, cutoff_no, upc): the first cutoff that gave a code."""
    return passes.groupBy("file").agg(F.min_by("upc", F.when(F.col("upc").isNotNull(), F.col("cutoff_no"))).alias("upc"))

"""Line segments beside word boxes: filters, the majority rule, the longest ones, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import line_crosses, near_horizontal, near_vertical


def filter_lines(lines: DataFrame, method: str = "horizontal", factor: int = 10) -> DataFrame:
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return lines.where((near_horizontal if method == "horizontal" else near_vertical)(*ends, factor))


def clear_of_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines that cross no word box of their image."""
    a, b = lines.alias("a"), boxes.alias("b")
    crosses = line_crosses(*(F.col(f"a.{c}") for c in ("x1", "y1", "x2", "y2")), *(F.col(f"b.{c}") for c in ("left", "top", "width", "height")))
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & crosses, "left_anti")


def by_ingredients(lines: DataFrame, items: DataFrame, side: str = "top") -> DataFrame:
    """Lines of a side that would leave out at most half of the ingredient words (image_id, text, left, top) and not the title; all, if none would."""
    outside = {"top": "b.top < a.y1", "bottom": "b.top > a.y1", "left": "b.left < a.x1", "right": "b.left > a.x1"}[side]
    t = lines.alias("a").join(items.alias("b"), F.col("a.image_id") == F.col("b.image_id"), "left")
    key = [F.col(f"a.{c}") for c in lines.columns]
    held = F.coalesce(~F.expr(outside), F.lit(False))
    bad = (F.coalesce(F.avg(held.cast("double")), F.lit(0.0)) > 0.5) | F.coalesce(F.bool_or(held & F.lower("b.text").contains("ingredients")), F.lit(False))
    judged = t.groupBy(*key).agg(bad.alias("_bad"))
    every = F.min(F.col("_bad").cast("int")).over(Window.partitionBy("image_id")) == 1
    return judged.withColumn("_all", every).where("not _bad or _all").select(lines.columns)


def longest(lines: DataFrame) -> DataFrame:
    """The longest line of each image; of equal ones that of the least line_id."""
    length = (F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2
    return lines.groupBy("image_id").agg(F.max_by(F.struct(*(c for c in lines.columns if c != "image_id")), F.struct(length.alias("l"), (-F.col("line_id")).alias("i"))).alias("r")).select("image_id", "r.*")


def total_least_squares(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, n, mx, my, theta, error): the line of least summed square distance, from five sums with partial aggregation."""
    m = points.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    root = F.sqrt((F.col("sxx") - F.col("syy")) ** 2 + 4 * F.col("sxy") ** 2)
    return m.select(by, "n", "mx", "my", (0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))).alias("theta"), F.greatest((F.col("sxx") + F.col("syy") - root) / 2, F.lit(0.0)).alias("error"))


def curvature_stats(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, avg, var, min, max, p25, p75); a quartile is the mean of the values at the ranks below and above a quarter of the last rank."""
    s = values.groupBy(by).agg(F.avg(value).alias("avg"), F.var_pop(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"), F.array_sort(F.collect_list(value)).alias("_s"))
    at = lambda q: (F.get("_s", F.floor((F.size("_s") - 1) * q).cast("int")) + F.get("_s", F.ceil((F.size("_s") - 1) * q).cast("int"))) / 2
    return s.withColumns({"p25": at(0.25), "p75": at(0.75)}).drop("_s")

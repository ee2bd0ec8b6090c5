"""Nutrition facts from cleaned word boxes: hits, their neighbours' rules, values, conflicts, merging, absence.

A fact is (image_id, nutrient, quantity, quantity_status, unit, dv, dv_status); a status is ok, conflict, absent, blank or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as ft
from ..storage import small, written
from ..vocabulary import AMOUNT_ONLY, FOREIGN, FRENCH, NEW_FORMAT, NEW_FORMAT_DISTANCE, SHORT, TERMS, UNITS
from .boxes import on_line, overlapping
from .fuzzy import phrase_hits


def _order() -> WindowSpec:
    return Window.partitionBy("image_id").orderBy("seq")


def with_neighbours(boxes: DataFrame) -> DataFrame:
    """boxes with ``before``, ``after`` and ``last`` (whether it is the image's last word); null beyond the ends."""
    return boxes.withColumns({"before": F.lag("text").over(_order()), "after": F.lead("text").over(_order())}).withColumn("last", F.col("after").isNull())


def choose_hits(hits: DataFrame) -> DataFrame:
    """Hits (image_id, nutrient, seq, line, before, after, last) by the neighbours' rules.

    On one line the first hit counts. Fat goes by a "total" before it, else by no "saturated" before it; sugars by "alcohols" after it and
    "total" before it, and not at all where the last hit ends the image; carbohydrate by "total"; fibre by no "soluble" beside it."""
    by = Window.partitionBy("image_id", "nutrient")
    many = (F.count("*").over(by) > 1) & (F.min("line").over(by) != F.max("line").over(by))
    is_ = lambda c, w: F.coalesce(F.col(c) == w, F.lit(False))
    has = lambda c, w: F.coalesce(F.col(c).contains(w), F.lit(False))
    total, n = is_("before", "total"), F.col("nutrient")
    rank = (
        F.when(~F.col("_many"), F.when(F.col("seq") == F.col("_first"), 0))
        .when((n == "sugars") & (F.col("_end") | is_("after", "alcohols")), None)
        .when(n.isin("fat", "sugars", "carbohydrate") & total, 0)
        .when(n == "fat", F.when(~has("before", "saturated"), 1).otherwise(2))
        .when(n.isin("sugars", "carbohydrate"), 1)
        .when((n == "fibre") & (has("before", "soluble") | has("after", "soluble")), 1)
        .otherwise(0)
    )
    marked = hits.withColumns({"_many": many, "_first": F.min("seq").over(by), "_end": F.max(F.col("last").cast("int")).over(by) == 1}).withColumn("_r", rank)
    return marked.where("_r is not null").withColumn("_b", F.min("_r").over(by)).where("_r = _b").select(hits.columns)


def _same(word: Column, term: str, most: int = 1) -> Column:
    """Whether a word is at most so many edits from a term; a vitamin's letter, the last one, has to be equal."""
    near = ft.within(word, F.lit(term), most)
    return near & (F.right(word, F.lit(1)) == term[-1]) if "vitamin" in term else near


def _names(nutrient: str) -> list[str]:
    """A nutrient's English name, its French one, and a short form, in the order they are looked for."""
    return list(dict.fromkeys([nutrient, FRENCH.get(nutrient, nutrient), *SHORT.get(nutrient, [])]))


def nutrient_hits(boxes: DataFrame, terms: list[str] = TERMS, most: int = 1) -> DataFrame:
    """(image_id, nutrient, seq) of each term in boxes of merged vitamins: by its English name, in images without that by the French one, or else by its short form.

    Each distinct word is compared with the terms once; the few that match are joined back."""
    tests = [F.when(_same(F.col("word"), name, most), F.struct(F.lit(t).alias("nutrient"), F.lit(level).alias("level"))) for t in terms for level, name in enumerate(_names(t))]
    words = written(boxes.select(F.lower("text").alias("word")).distinct())
    known = written(words.select("word", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")).select("word", "x.*"))
    found = boxes.select("image_id", "seq", F.lower("text").alias("word")).join(small(known), "word")
    best = F.min("level").over(Window.partitionBy("image_id", "nutrient"))
    return found.withColumn("_m", best).where("level = _m").select("image_id", "nutrient", "seq")


def term_at(terms: list[str] = TERMS, items: str = "items", nutrient: str = "nutrient") -> Column:
    """Position of the right-most word of a line that is the row's nutrient, in English or French, or else its short form; null where there is none."""
    last = lambda name: F.array_max(F.transform(items, lambda w, i: F.when(_same(w, name), i)))
    out = F.lit(None).cast("int")
    for t in terms:
        french = FRENCH.get(t, t)
        at = F.coalesce(last(t) if french == t else F.greatest(last(t), last(french)), *(last(name) for name in SHORT.get(t, [])))
        out = F.when(F.col(nutrient) == t, at).otherwise(out)
    return out


def line_items(boxes: DataFrame, hits: DataFrame) -> DataFrame:
    """(image_id, nutrient, seq, items): the words from each hit to the right on its line; for saturated and trans any overlap counts."""
    seed = hits.join(boxes.select("image_id", "seq", "top", "height", "left"), ["image_id", "seq"])
    i, j = seed.alias("i"), boxes.alias("j")
    wide = F.col("i.nutrient").isin("saturated", "trans")
    pairs = i.join(j, (F.col("i.image_id") == F.col("j.image_id")) & (F.col("j.left") >= F.col("i.left")) & F.when(wide, overlapping()).otherwise(on_line()))
    listed = F.array_sort(F.collect_list(F.struct((F.col("j.left") - F.col("i.left")).alias("d"), F.col("j.seq").alias("s"), F.col("j.text").alias("t"))))
    return pairs.groupBy(F.col("i.image_id").alias("image_id"), F.col("i.nutrient").alias("nutrient"), F.col("i.seq").alias("seq")).agg(listed["t"].alias("items"))


def extract(items: DataFrame, column: str = "items", at: str | Column = "at") -> DataFrame:
    """items with quantity, unit and dv, read behind the term at position ``at`` (from 0) of the line.

    The value is the next word, or the one after. Without a unit behind it, a "%" makes it the share; a "%" one further on makes the next word the share."""
    a = F.col(at) if isinstance(at, str) else at
    word = lambda n: F.get(column, (a + n).cast("int"))
    shift = F.when(ft.number(word(1)).isNotNull(), 1).when(ft.number(word(2)).isNotNull(), 2)
    t = items.withColumn("_s", shift)
    after = lambda n: F.get(column, (a + F.col("_s") + n).cast("int"))
    value, unit = ft.number(after(0)), F.when(after(1).isin(UNITS), after(1))
    only = F.col("nutrient").isin(AMOUNT_ONLY)
    share = ~only & unit.isNull() & F.coalesce(after(1) == "%", F.lit(False))
    quantity = F.when(~share, value)
    unit_out = F.when(F.col("_s").isNotNull(), F.when(F.col("nutrient") == "calories", F.lit("kcal")).otherwise(unit))
    dv = F.when(only, None).when(share, value).when(unit.isNotNull(), ft.number(after(2))).when(after(2) == "%", ft.number(after(1)))
    return t.withColumns({"quantity": quantity, "unit": unit_out, "dv": dv}).drop("_s")


def single(value: str) -> Column:
    """Aggregate: the one distinct value of a group, null where there are several."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def status(value: str) -> Column:
    """Aggregate: ok, or conflict where a group has several distinct values; nulls don't count. Independent of order, so partial aggregates do."""
    return F.when(F.min(value) == F.max(value), F.lit("ok")).when(F.min(value).isNotNull(), F.lit("conflict"))


def facts(values: DataFrame) -> DataFrame:
    """One row of each (image_id, nutrient) of values that agree."""
    rows = values.groupBy("image_id", "nutrient").agg(single("quantity").alias("quantity"), status("quantity").alias("quantity_status"), F.when(status("unit") == "conflict", F.lit("conflict")).otherwise(single("unit")).alias("unit"), single("dv").alias("dv"), status("dv").alias("dv_status"))
    return rows.withColumn("dv_status", F.when(F.col("nutrient").isin(AMOUNT_ONLY), F.lit("blank")).otherwise(F.col("dv_status")))


def merge(first: DataFrame, second: DataFrame, test_conflicts: bool = False) -> DataFrame:
    """What the first facts lack is filled from the second's, of the first's nutrients but portion_size; on request differing values become conflicts."""
    b = second.select("image_id", "nutrient", *(F.col(c).alias(f"_{c}") for c in ("quantity", "quantity_status", "unit", "dv", "dv_status"))).where("nutrient <> 'portion_size'")
    t = first.join(b, ["image_id", "nutrient"], "left")
    out = {}
    for c in ("quantity", "dv"):
        own, other = F.col(f"{c}_status"), F.col(f"_{c}_status")
        clash = (own == "ok") & (other == "ok") & (F.col(c) != F.col(f"_{c}")) if test_conflicts else F.lit(False)
        out[c] = F.when(clash, None).when(own.isNull(), F.col(f"_{c}")).otherwise(F.col(c))
        out[f"{c}_status"] = F.when(clash, F.lit("conflict")).otherwise(F.coalesce(own, other))
    out["unit"] = F.when((F.col("unit") != F.col("_unit")) if test_conflicts else F.lit(False), F.lit("conflict")).otherwise(F.coalesce("unit", "_unit"))
    return t.withColumns(out).select(first.columns)


def complete(found: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """A row of every term for each image that has any fact."""
    every = found.select("image_id").distinct().crossJoin(F.broadcast(found.sparkSession.createDataFrame([(t,) for t in terms], "nutrient string")))
    extra = found.where(~F.col("nutrient").isin(terms))
    return every.join(found, ["image_id", "nutrient"], "left").select(found.columns).unionByName(extra)


def mark_absent(found: DataFrame, hits: DataFrame, phrase: DataFrame) -> DataFrame:
    """Empty nutrients without a hit, or with all hits behind the image's first "not a significant source", are absent.
    hits: (image_id, nutrient, seq); phrase: (image_id, seq)."""
    first = hits.groupBy("image_id", "nutrient").agg(F.min("seq").alias("_first"))
    where = phrase.groupBy("image_id").agg(F.min("seq").alias("_p"))
    t = found.join(first, ["image_id", "nutrient"], "left").join(where, "image_id", "left")
    empty = F.col("quantity_status").isNull() & F.col("unit").isNull() & (F.col("dv_status").isNull() | (F.col("dv_status") == "blank"))
    gone = empty & F.coalesce(F.col("_first").isNull() | (F.col("_first") > F.col("_p")), F.lit(False))
    put = lambda c: F.when(gone, F.lit("absent")).otherwise(F.col(c))
    dv = F.when(gone & ~F.col("nutrient").isin(AMOUNT_ONLY), F.lit("absent")).otherwise(F.col("dv_status"))
    return t.withColumns({"quantity_status": put("quantity_status"), "unit": put("unit"), "dv_status": dv}).select(found.columns)


def new_format(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id): labels of the new format: its phrase is there, or a mineral is given in mg."""
    phrase = phrase_hits(boxes, NEW_FORMAT, NEW_FORMAT_DISTANCE).select("image_id")
    return phrase.unionAll(found.where(F.col("nutrient").isin("potassium", "iron", "calcium") & (F.col("unit") == "mg")).select("image_id")).distinct()


def mark_by_format(found: DataFrame, new: DataFrame) -> DataFrame:
    """Cells that a label's format doesn't have: the share of carbohydrate on new ones; that of sugars, and vitamins' amounts, on old ones."""
    t = found.join(new.select("image_id").withColumn("_new", F.lit(True)), "image_id", "left")
    fresh, vitamin = F.coalesce("_new", F.lit(False)), F.col("nutrient").isin([n for n in TERMS if n.startswith("vitamin") or n in ("iron", "calcium", "phosphorus", "magnesium", "zinc", "potassium")])
    no_dv = (fresh & (F.col("nutrient") == "carbohydrate")) | (~fresh & (F.col("nutrient") == "sugars"))
    no_amount = ~fresh & vitamin
    return t.withColumns({
        "dv": F.when(no_dv, None).otherwise(F.col("dv")), "dv_status": F.when(no_dv, F.lit("absent")).otherwise(F.col("dv_status")),
        "quantity": F.when(no_amount, None).otherwise(F.col("quantity")), "quantity_status": F.when(no_amount, F.lit("absent")).otherwise(F.col("quantity_status")),
        "unit": F.when(no_amount, F.lit("absent")).otherwise(F.col("unit")),
    }).select(found.columns)


def missing(found: DataFrame) -> DataFrame:
    """Facts without an amount or unit, or in conflict; calories need no unit."""
    lack = F.col("quantity_status").isNull() | (F.col("quantity_status") == "conflict")
    return found.where(lack | ((F.col("nutrient") != "calories") & (F.col("unit").isNull() | (F.col("unit") == "conflict"))))


def foreign_labels(merged: DataFrame, least: int = 3) -> DataFrame:
    """(image_id, terms): labels on which the first places of at least three of the other format's terms share a line with another one. Words have to be equal."""
    hits = merged.where(F.col("text").isin(FOREIGN)).select("image_id", "seq", "top", "height", "text")
    first = hits.withColumn("_f", F.min("seq").over(Window.partitionBy("image_id", "text"))).where("seq = _f")
    pairs = first.alias("i").join(hits.alias("j"), (F.col("i.image_id") == F.col("j.image_id")) & (F.col("i.text") != F.col("j.text")) & on_line())
    return pairs.groupBy(F.col("i.image_id").alias("image_id")).agg(F.count_distinct("i.text").alias("terms")).where(F.col("terms") >= least)


def serving_hits(boxes: DataFrame) -> DataFrame:
    """(image_id, nutrient, seq) of the words before a serving's size."""
    two = F.lag("text", 2).over(_order())
    t = with_neighbours(boxes).withColumn("_two", two)
    per = (ft.starts_or_ends("text", F.lit("per")) | ft.starts_or_ends("text", F.lit("pour")) | ft.starts_or_ends("text", F.lit("par"))) & (F.col("text") != "copper") & F.coalesce(F.col("before") != "amount", F.lit(True))
    serving = (ft.within("text", F.lit("serving"), 1) | ft.within("text", F.lit("portion"), 1)) & F.coalesce(F.col("before") != "per", F.lit(True)) & F.coalesce(F.col("_two") != "amount", F.lit(True))
    return t.where(per | serving).select("image_id", F.lit("portion_size").alias("nutrient"), "seq")


def serving_at(items: Column) -> Column:
    """Position before the first number that a "g" or "ml" follows."""
    ok = F.transform(items, lambda w, i: F.when((i >= 1) & w.rlike("^[0-9]+") & F.get(items, i + 1).isin("g", "ml"), i - 1))
    return F.array_min(ok)


def wide(found: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """One row an image, a struct column a nutrient. The names are given, so the pivot needs no pass of its own."""
    return found.groupBy("image_id").pivot("nutrient", terms).agg(F.first(F.struct("quantity", "unit", "dv")))


def as_map(found: DataFrame) -> DataFrame:
    return found.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("nutrient", F.struct("quantity", "unit", "dv"))))).alias("facts"))

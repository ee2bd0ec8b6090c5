"""Ingredient lists: runs of blocks, bilingual lists, language, spelling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from .fuzzy import nearest_word

HEADER_DISTANCE = 1
_TITLE = regex.compile(r"(?:Ingredients){e<=2}")


def header(text: str = "text", title: str = "ingredients", most: int = HEADER_DISTANCE) -> Column:
    """Whether the first word of a block is the title, but for an edit."""
    first = F.regexp_extract(F.lower(text), r"^\s*([^\s:]+)", 1)
    return ft.within(first, F.lit(title), most)


def contains_word(text: str, words: list[str]) -> Column:
    """Whether a block has any of the words as a part."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(text).contains(w)
    return out


def islands(blocks: DataFrame, is_header: Column, has_word: Column, by: str = "file", pos: str = "pos") -> DataFrame:
    """(by, first, ingr_string): a header block that has a dictionary word starts a run, which goes on while blocks have one; texts joined by ", ".

    Gaps and islands: a segment begins at every header and every block without a word; it counts if its first block is a header with a word."""
    order = Window.partitionBy(by).orderBy(pos)
    marked = blocks.withColumns({"_h": F.coalesce(is_header, F.lit(False)), "_w": F.coalesce(has_word, F.lit(False))})
    cut = marked.withColumn("_g", F.sum((F.col("_h") | ~F.col("_w")).cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t"), (F.col("_h") & F.col("_w")).alias("ok"))))
    runs = cut.groupBy(by, "_g").agg(listed.alias("r")).where(F.col("r")[0]["ok"])
    return runs.select(by, F.col("r")[0]["p"].alias("first"), F.array_join(F.col("r")["t"], ", ").alias("ingr_string"))


def lists(blocks: DataFrame, files: DataFrame, words: list[str]) -> DataFrame:
    """(file, first, ingr_string); a file without a block has one row with an empty text."""
    found = islands(blocks, header(), contains_word("text", words))
    none = files.select("file").distinct().join(blocks.select("file").distinct(), "file", "left_anti")
    return found.unionByName(none.select("file", F.lit(0).alias("first"), F.lit("").alias("ingr_string")))


def split_bilingual(text: str | None) -> list[str] | None:
    """The two halves of a text with exactly two titles (two errors allowed, case matters), the first within its first six characters."""
    hits = [m.start() for m in _TITLE.finditer(text or "")]
    return [text[: hits[1]].strip(), text[hits[1] :].strip()] if len(hits) == 2 and hits[0] <= 5 else None


def bilingual(table: DataFrame, column: str = "ingr_string") -> DataFrame:
    """Rows with two titled lists become two rows; others stay."""

    @F.pandas_udf("array<string>")
    def halves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(split_bilingual)

    # only texts that can hold two titles go to Python
    maybe = F.length(column) >= 18
    return table.withColumn(column, F.explode(F.coalesce(F.when(maybe, halves(column)), F.array(column))))


def with_language(table: DataFrame, text: str, english: list[str], french: list[str], stop: list[str], name: str = "language") -> DataFrame:
    """table with en, fr or unclear by how many words, but stop words, each lexicon has: one must have half of them; ties are unclear.

    The words are made once, in a column of their own, and counted from there."""
    both = set(english) & set(french)
    kind = lambda w: F.when(w.isin(stop), -1).when(w.isin([x for x in english if x not in both]), 1).when(w.isin([x for x in french if x not in both]), 2).otherwise(F.when(w.isin(sorted(both)), 3).otherwise(0) if both else 0)
    t = table.withColumn("_k", F.transform(ft.split_to_words(text), kind))
    # a string of digits: counting its characters stays in compiled code
    t = t.withColumn("_s", F.array_join(F.filter("_k", lambda k: k >= 0), ""))
    n, one, two, three = (F.length(F.regexp_replace("_s", p, "")) if p else F.length("_s") for p in ("", "[^1]", "[^2]", "[^3]"))
    t = t.withColumns({"_n": n, "_e": one + three, "_f": two + three})
    n, en, fr = F.col("_n"), F.col("_e"), F.col("_f")
    out = F.when(F.coalesce(n, F.lit(0)) == 0, "unclear").when((en < n / 2) & (fr < n / 2), "unclear").when(en > fr, "en").when(fr > en, "fr").otherwise("unclear")
    return t.withColumn(name, out).select(*[c for c in table.columns if c != name], name)


def correct(table: DataFrame, dictionary: DataFrame, key: str, column: str = "ingr_string", least: int = 5, most: int = 2) -> DataFrame:
    """table with ``<column>_corrected`` and ``n_corrections``: words of at least so many letters are replaced by their single nearest dictionary word.

    Each distinct word is looked up once, by an equi-join on deletion variants; delimiters stay where they are."""
    tokens = F.filter(F.regexp_extract_all(column, F.lit(r"([,.;: ()]|[^,.;: ()]+)"), 1), lambda p: p != "")
    rows = table.select(key, F.posexplode(tokens).alias("pos", "token")).withColumn("word", F.lower("token"))
    wanted = rows.where(F.length("token") >= least).select("word").distinct()
    fixed = nearest_word(wanted.join(dictionary, "word", "left_anti"), dictionary, most).select("word", "correction")
    t = rows.join(fixed, "word", "left")
    joined = t.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("correction", "token").alias("t"))))["t"], "").alias(f"{column}_corrected"), F.count("correction").cast("int").alias("n_corrections"))
    return table.join(joined, key, "left").withColumns({f"{column}_corrected": F.coalesce(f"{column}_corrected", column), "n_corrections": F.coalesce("n_corrections", F.lit(0))})

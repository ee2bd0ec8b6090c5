"""Nested responses of a text detector flattened with higher-order functions; no row is exploded before it has to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import polygon_box


def words_text(words: Column) -> Column:
    return F.transform(words, lambda w: F.array_join(w["symbols"]["text"], ""))


def block_text(block: Column) -> Column:
    """A block's words with blanks between."""
    return F.array_join(F.flatten(F.transform(block["paragraphs"], lambda p: words_text(p["words"]))), " ")


def first_page(responses: DataFrame) -> Column:
    return F.coalesce(F.get("full_text_annotation.pages", 0)["blocks"], F.expr("array()").cast(responses.select("full_text_annotation.pages").schema[0].dataType.elementType["blocks"].dataType))


def blocks(responses: DataFrame) -> DataFrame:
    """(file, pos, text) of the blocks of each response's first page; a response without a page gives no row."""
    return responses.select("file", F.posexplode(F.transform(first_page(responses), block_text)).alias("pos", "text"))


def block_boxes(responses: DataFrame) -> DataFrame:
    """(file, pos, x0, y0, x1, y1) of the same blocks."""
    return responses.select("file", F.posexplode(F.transform(first_page(responses), lambda b: polygon_box(b["bounding_box"]["vertices"]))).alias("pos", "b")).select("file", "pos", "b.*")


def text_annotations(responses: DataFrame) -> DataFrame:
    """(file, pos, text, box) of each response's flat list; its first entry is the whole text."""
    one = lambda a: F.struct(a["description"].alias("text"), polygon_box(a["bounding_poly"]["vertices"]).alias("box"))
    return responses.select("file", F.posexplode(F.transform("text_annotations", one)).alias("pos", "a")).select("file", "pos", "a.text", "a.box")

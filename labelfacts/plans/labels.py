"""Whole plans, from word boxes or annotations to tables of facts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as ft
from ..operators import annotations as an
from ..operators import boxes as bx
from ..operators import facts as fc
from ..operators import ingredients as ig
from ..operators import upc
from ..operators import words as wd
from ..storage import written
from ..vocabulary import ABSENT, LINE_FUDGE, NEW_FORMAT, NEW_FORMAT_DISTANCE, SMALL_HEIGHT, TERMS, WHOLE


def vocabulary(w: wd.Words) -> None:
    wd.merge_vocabulary(w, WHOLE)


#: From recognised words to the items that nutrients are looked for in.
MERGED = (wd.clean_up, wd.merge_vitamins, vocabulary)


def merged(clean: DataFrame) -> DataFrame:
    """Clean boxes with vitamins and parted words as one item each: what nutrients are looked for in."""
    return bx.stepped(clean, *MERGED[1:])


def made(boxes: DataFrame, steps: tuple[Callable[[wd.Words], None], ...], of: Callable[[wd.Words], tuple[np.ndarray, dict]], columns: str) -> DataFrame:
    """Rows that ``of`` makes of the words, or printed lines, after the steps: rows of the batch that tell the image, and the columns besides image_id."""
    kind = T.StructType([boxes.schema["image_id"], *T._parse_datatype_string(columns)])
    arrow = to_arrow_schema(kind)

    def run(w: wd.Words) -> pa.Table:
        for step in steps:
            step(w)
        row, out = of(w)
        return pa.table([w.table["image_id"].take(pa.array(row)), *(out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type, from_pandas=True) for f in list(arrow)[1:])], arrow)

    return bx.in_one_pass(boxes.select("image_id", *(c for c in ("seq", "line_no", "text", "left", "top", "width", "height") if c in boxes.columns)), run, kind)


def _nutrients(terms: list[str], numbers: np.ndarray) -> pa.Array:
    return pa.array([*terms, wd.SERVING]).take(pa.array(numbers))


def phrase_hits(boxes: DataFrame, terms: list[str], most: int = 1, steps: tuple = (), unique: bool = False) -> DataFrame:
    """fuzzy.phrase_hits of the words after the steps; ``unique``: (image_id, term, seq) of terms with exactly one hit in their image."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        at, term, found = wd.phrases(w, terms, most)
        found = np.array(found, object)
        if unique:
            order, starts = wd.groups(w.image[at], term)
            alone = order[starts[wd.sizes(starts, len(order)) == 1]]
            at, term, found = at[alone], term[alone], found[alone]
        return w.row[at], {"seq": w.seq[at], "term": pa.array(terms).take(pa.array(term)), "found": found}

    t = made(boxes, steps, of, "seq int, term string, found string")
    return t.select("image_id", "term", "seq") if unique else t


def nutrient_hits(boxes: DataFrame, terms: list[str] = TERMS, steps: tuple = MERGED, chosen: bool = True, named: bool = False) -> DataFrame:
    """(image_id, nutrient, seq) of the words after the steps, by the neighbours' rules if ``chosen``; ``named``: and ``at``, the position of the nutrient's right-most name on its line."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        at, term = wd.nutrient_hits(w, terms)
        if chosen:
            at, term = wd.choose_hits(w, at, term, terms)
        out = {"nutrient": _nutrients(terms, term), "seq": w.seq[at]}
        if named:
            place = wd.term_at(wd.Items(w, at, wd.wide(term, terms)), term, terms)
            at, out = at[place >= 0], {k: v.filter(pa.array(place >= 0)) if isinstance(v, pa.Array) else v[place >= 0] for k, v in (out | {"at": place}).items()}
        return w.row[at], out

    return made(boxes, steps, of, "nutrient string, seq int" + ", at int" * named)


def serving_sizes(boxes: DataFrame, steps: tuple = MERGED) -> DataFrame:
    """(image_id, seq, at): words before a serving's size, and the position before its number on their line."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        at = wd.serving_hits(w)
        place = wd.serving_at(wd.Items(w, at, np.zeros(len(at), bool)))
        return w.row[at[place >= 0]], {"seq": w.seq[at[place >= 0]], "at": place[place >= 0]}

    return made(boxes, steps, of, "seq int, at int")


def listed_pairs(boxes: DataFrame, test: Callable[[wd.Words, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, i, pairs): for each word those of its image that the test lets through, as "seq:distance" by distance."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        at, pairs = wd.listed_pairs(w, test)
        return w.row[at], {"i": w.seq[at], "pairs": pairs}

    return made(boxes, (), of, "i int, pairs string")


def greedy_lines(boxes: DataFrame) -> DataFrame:
    """boxes.greedy_lines: (image_id, seq, line)."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        line = bx.number_lines(w.top, w.height, np.flatnonzero(np.diff(w.image, prepend=-1)), LINE_FUDGE, SMALL_HEIGHT)
        return w.row, {"seq": w.seq, "line": line}

    return made(boxes, (), of, "seq int, line int")


def values(boxes: DataFrame, terms: list[str] = TERMS, steps: tuple = MERGED) -> DataFrame:
    """(image_id, nutrient, quantity, unit, dv) of every chosen hit, and of servings."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        v = wd.values(w, terms)
        return w.starts[v["image"]], v | {"nutrient": _nutrients(terms, v["nutrient"]), "unit": w.text(v["unit"])}

    return made(boxes, steps, of, "nutrient string, quantity double, unit string, dv double")


def facts(boxes: DataFrame, terms: list[str] = TERMS, steps: tuple = MERGED, absent: bool = False, by_format: bool = False) -> DataFrame:
    """(image_id, nutrient, quantity, quantity_status, unit, dv, dv_status) of the words after the steps.

    absent: with a row for each term, and absence marked; by_format: and the cells marked that a label's format doesn't have."""

    def of(w: wd.Words) -> tuple[np.ndarray, dict]:
        hits = wd.nutrient_hits(w, terms)
        f = wd.facts(w, wd.values(w, terms, hits), terms)
        if absent:
            f = wd.complete(f, terms)
            wd.mark_absent(w, f, hits, wd.phrases(w, [ABSENT], 1)[0], terms)
        if by_format:
            wd.mark_by_format(w, f, wd.phrases(w, NEW_FORMAT, NEW_FORMAT_DISTANCE)[0], terms)
        out = {"nutrient": _nutrients(terms, f["nutrient"]), "unit": w.text(f["unit"])} | {c: wd.STATUS.take(pa.array(f[c], mask=f[c] < 0)) for c in ("quantity_status", "dv_status")}
        return w.starts[f["image"]], f | out

    return made(boxes, steps, of, "nutrient string, quantity double, quantity_status string, unit string, dv double, dv_status string")


def own_format(w: wd.Words) -> None:
    """Labels of the other country's format are left out."""
    w.keep(~np.isin(w.image, wd.foreign(w)))


#: As MERGED, for labels of this country only.
OWN = (wd.clean_up, wd.merge_vitamins, own_format, vocabulary)


def nutrition_facts(boxes: DataFrame, second: DataFrame | None = None, drop: tuple[str, ...] = ("vitamin e",)) -> DataFrame:
    """Facts of every image, a row for each term; labels of the other country's format are left out.

    second: word boxes of another recognition, used for images with any empty cell."""
    terms = [t for t in TERMS if t not in drop]
    if second is None:
        return facts(boxes, terms, OWN, absent=True, by_format=True)
    own = written(bx.stepped(boxes, *OWN))
    found = written(fc.complete(facts(own, terms, ()), terms))
    wanted = fc.missing(found).select("image_id").distinct()
    found = fc.merge(found, facts(second.join(wanted, "image_id", "left_semi")))
    marked = written(fc.mark_absent(found, nutrient_hits(own, terms, (), chosen=False), phrase_hits(own, [ABSENT]).select("image_id", "seq")))
    return fc.mark_by_format(marked, fc.new_format(own, marked))


def ingredients(responses: DataFrame, dictionary: DataFrame, words: list[str], english: list[str], french: list[str], stop: list[str]) -> DataFrame:
    """(Filename, ingr_string, language, ingr_string_corrected, n_corrections); only English lists are corrected."""
    listed = ig.with_language(ig.bilingual(ig.lists(an.blocks(responses), responses, words)), "ingr_string", english, french, stop)
    keyed = listed.withColumn("_k", F.xxhash64("file", "first", "ingr_string"))
    fixed = ig.correct(keyed.where("language = 'en'"), dictionary, "_k")
    other = keyed.where("language <> 'en'").withColumns({"ingr_string_corrected": F.lit(None).cast("string"), "n_corrections": F.lit(None).cast("int")})
    return fixed.unionByName(other).select(F.col("file").alias("Filename"), "ingr_string", "language", "ingr_string_corrected", "n_corrections")


def barcodes(responses: DataFrame) -> DataFrame:
    """(file_names, upc_codes)."""
    return upc.codes(an.text_annotations(responses)).select(F.col("file").alias("file_names"), F.col("upc").alias("upc_codes"))


def expiry_dates(responses: DataFrame) -> DataFrame:
    """(file, text, expiry_date) of every block: a scan, an explode and a projection."""
    return an.blocks(responses).select("file", "text", ft.extract_expiry("text").alias("expiry_date"))

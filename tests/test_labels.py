"""Operators of food labels on small hand-made boxes, and parity with DuckDB on the driver's smallest tables."""

from __future__ import annotations

import glob
import itertools
import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelfacts.functions import boxes as fb
from labelfacts.functions import conics as cn
from labelfacts.functions import pixels as px
from labelfacts.functions import text as ft
from labelfacts.operators import annotations as an
from labelfacts.operators import boxes as bx
from labelfacts.operators import curves as cv
from labelfacts.operators import facts as fc
from labelfacts.operators import fuzzy as fz
from labelfacts.operators import images as im
from labelfacts.operators import ingredients as ig
from labelfacts.operators import upc
from labelfacts.plans import labels
from labelfacts.plans.queries import QUERIES, SQL
from labelfacts.sources import readers as rd
from labelfacts.streaming import annotations as st

SF = "/root/testdata/sf0.001"
BOXES = "image_id long, seq int, text string, `left` int, top int, width int, height int"


def page(spark, *lines: str, image: int = 1):
    rows, seq = [], 0
    for i, line in enumerate(lines):
        at = 0
        for w in line.split():
            rows.append((image, seq, w, at, 40 * i, 10 * len(w), 20))
            seq, at = seq + 1, at + 10 * (len(w) + 1)
    return spark.createDataFrame(rows, BOXES)


def facts(spark, *lines: str, **more) -> dict:
    return {r.nutrient: r for r in labels.nutrition_facts(page(spark, *lines), **more).collect()}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2,5", "2.5"), ("G*", "g"), ("4gt", "4g"), ("4gf", "4g"), ("Fiber", "fibre"), ("Saturés", "sature"), ("Sugarstt", "sugars"), ("(31g)", "31g"), ("10Omg", "0g")],
)
def test_clean_word(spark, raw, want):
    assert one(spark, ft.fix_spelling(ft.oh_to_zero(ft.clean("t"))), t=raw) == want


def test_split_keeps_numbers_and_shares_width(spark):
    got = bx.split_items(page(spark, "fat/lipides 17.5mg plain")).orderBy("seq").collect()
    assert [r.text for r in got] == ["fat", "lipides", "17.5", "mg", "plain"]
    assert [r.seq for r in got] == list(range(5))
    assert [r.left for r in got][2:4] == [120, 160]


@pytest.mark.parametrize(
    ("lines", "nutrient", "want"),
    [
        (["total fat 3 g 5 %"], "fat", (3.0, "ok", "g", 5.0)),
        (["protein 6 g", "protein 7 g"], "protein", (None, "conflict", "g", None)),
        (["fat 5 %"], "fat", (None, None, None, 5.0)),
        (["calories 110"], "calories", (110.0, "ok", "kcal", None)),
        (["glucides 6 7 %"], "carbohydrate", (6.0, "ok", None, 7.0)),
        (["Sugars 5 g", "sugars alcohols 2 g"], "sugars", (5.0, "ok", "g", None)),
        (["sodium/sodium 20 mg 1 %"], "sodium", (20.0, "ok", "mg", 1.0)),
        (["Per 3/4 cup (31g)", "fat 1 g"], "portion_size", (31.0, "ok", "g", None)),
    ],
)
def test_facts(spark, lines, nutrient, want):
    r = facts(spark, *lines)[nutrient]
    assert (r.quantity, r.quantity_status, r.unit, r.dv) == want


def test_vitamins_go_by_their_letter(spark):
    for lines in (["vitamin a 4 %", "vitamin c 10 %"], ["vitamin a 4 % vitamin c 10 %"], ["vitamine a 4 %", "vitamine c 10 %"]):
        got = facts(spark, "fat 1 g", *lines)
        assert (got["vitamin a"].dv, got["vitamin c"].dv, got["vitamin a"].dv_status) == (4.0, 10.0, "ok")
    assert facts(spark, "fat 1 g", "cholest 15 mg")["cholesterol"].quantity == 15.0
    assert facts(spark, "fat 1 g", "prot eine/protéines 6 g")["protein"].quantity == 6.0
    assert facts(spark, "protein / protéines 6 g")["protein"].quantity == 6.0


def test_absent_and_second_pass(spark):
    got = facts(spark, "fat 3 g", "not a significant source of fibre")
    assert got["fibre"].quantity_status == got["fibre"].unit == got["fibre"].dv_status == "absent"
    got = facts(spark, "fat 3 g", second=page(spark, "fat 4 g 6 %"))
    assert (got["fat"].quantity, got["fat"].dv) == (3.0, 6.0)


def test_foreign_label_is_left_out(spark):
    assert fc.foreign_labels(bx.merge_vitamins(page(spark, "vitamin a calcium", "vitamin c iron"))).first().terms == 4
    # one complete line is not enough, nor are names with an edit
    assert fc.foreign_labels(bx.merge_vitamins(page(spark, "vitamin a calcium", "vitamin c", "iron", "calciun zinc"))).count() == 0
    assert facts(spark, "vitamin a 1 % calcium 2 %", "vitamin c 1 % iron 2 %") == {}


def test_conflict_does_not_depend_on_order(spark):
    rows = [(i, v) for i, p in enumerate(itertools.permutations([None, 5.0, 5.0, 2.0])) for v in p]
    got = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(fc.status("v").alias("s")).select("s").distinct().collect()
    assert [r.s for r in got] == ["conflict"]


def test_footer_calories_from_and_vitamins(spark):
    t = page(spark, "calories from fat 30", "vitamin a 4 %", "Teneur de la chose", "rest")
    assert [r.text for r in bx.clean_up(t).orderBy("seq").collect()] == ["vitamin", "a", "4", "%"]
    got = bx.merge_vitamins(page(spark, "vitamin a 4 vitamin b 6 vitamin")).orderBy("seq").collect()
    assert [r.text for r in got] == ["vitamin a", "4", "vitamin b 6", "vitamin"]
    assert [r.text for r in bx.merge_vocabulary(page(spark, "sod ium fat"), ["sodium"]).orderBy("seq").collect()] == ["sod ium", "fat"]


def test_greedy_lines_match_brute_force(spark):
    got = bx.greedy_lines(page(spark, "a b", "c")).orderBy("seq").collect()
    assert [r.line for r in got] == [0, 0, 1]


def test_deletion_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(3, 7))) for _ in range(80)]
    a, b = ([(w,) for w in words[:40]], [(w,) for w in words[40:]])
    left, right = spark.createDataFrame(a, "word string"), spark.createDataFrame(b, "word string")
    got = {(r.word, r.near, r.distance) for r in fz.candidates(left, right).collect()}
    every = left.distinct().crossJoin(right.distinct().withColumnRenamed("word", "near")).withColumn("distance", F.levenshtein("word", "near")).where("distance <= 2")
    assert got == {(r.word, r.near, r.distance) for r in every.collect()}


def test_spelling(spark):
    d = spark.createDataFrame([("water",), ("sugar",), ("wafer",)], "word string")
    t = spark.createDataFrame([(1, "suger, waler. water (sugar)")], "k int, ingr_string string")
    r = ig.correct(t, d, "k").first()
    assert (r.ingr_string_corrected, r.n_corrections) == ("sugar, waler. water (sugar)", 1)


def test_islands_equal_the_state_machine(spark):
    rows, want = [], {}
    for k, kinds in enumerate(itertools.product(range(4), repeat=4)):
        runs, now = [], None
        for pos, kind in enumerate(kinds):
            head, word = kind >= 2, kind % 2 == 1
            text = f"t{pos}"
            rows.append((k, pos, text, head, word))
            if head and word:
                now = [text]
                runs.append(now)
            elif word and not head and now is not None:
                now.append(text)
            else:
                now = None
        want[k] = [", ".join(r) for r in runs]
    t = spark.createDataFrame(rows, "file int, pos int, text string, h boolean, w boolean")
    got = {k: [] for k in want}
    for r in ig.islands(t, F.col("h"), F.col("w")).orderBy("file", "first").collect():
        got[r.file].append(r.ingr_string)
    assert got == want


def test_bilingual_language_and_expiry(spark):
    halves = ig.split_bilingual("Ingredients: water, salt. Ingrédients: eau, sel")
    assert halves[0].startswith("Ingredients: water, salt") and halves[1].endswith("ients: eau, sel")
    assert ig.split_bilingual("INGREDIENTS: water") is None and ig.split_bilingual(None) is None
    t = spark.createDataFrame([("",), ("water, water, eau",), (None,), ("eau",), ("pain pain",)], "t string")
    assert [r.language for r in ig.with_language(t, "t", ["water", "pain"], ["eau", "pain"], []).collect()] == ["unclear", "en", "unclear", "fr", "unclear"]
    for text, want in (("BEST BEFORE 2021 JA 05", "2021 JA 05"), ("2021JUN05", "2021JUN05"), ("JA 05 2021", "JA 05 2021"), ("05/06/2021", None)):
        assert one(spark, ft.extract_expiry("t"), t=text) == want


def _annotation(file: str, parts: list[tuple[str, int, int]]) -> dict:
    v = lambda x0, x1: {"vertices": [{"x": x0, "y": 0}, {"x": x1, "y": 0}, {"x": x1, "y": 9}, {"x": x0, "y": 9}]}
    blocks = [{"bounding_box": v(x0, x1), "paragraphs": [{"words": [{"symbols": [{"text": c} for c in w]} for w in t.split()]}]} for t, x0, x1 in parts]
    return {"file": file, "full_text_annotation": {"pages": [{"blocks": blocks}] if parts else []}, "text_annotations": [{"description": t, "bounding_poly": v(x0, x1)} for t, x0, x1 in parts]}


@pytest.fixture
def responses(spark, tmp_path):
    rows = [
        _annotation("whole", [("0 12345 67890 5", 0, 100), ("0", 0, 5), ("12345", 10, 40), ("67890", 50, 80), ("5", 90, 95)]),
        _annotation("parts", [("junk", 10, 80), ("12345", 10, 40), ("67890", 50, 80), ("0", 0, 5), ("5", 90, 95)]),
        _annotation("side", [("junk", 10, 80), ("12345", 10, 40), ("67890", 50, 80), ("0", 0, 5)]),
        _annotation("food", [("NET WT 500G", 0, 9), ("INGREDIENTS: WATER, SALT", 0, 9), ("SUGAR, MILK", 0, 9), ("BEST BEFORE 2021 JA 05", 0, 9), ("INGREDIENTS: WATER", 0, 9)]),
        _annotation("none", []),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path / "in")


def test_annotations_barcodes_lists(spark, responses, tmp_path):
    t = rd.annotations_json(spark, responses)
    codes = {r.file_names: r.upc_codes for r in labels.barcodes(t).collect()}
    assert (codes["whole"], codes["parts"], codes["side"]) == ("012345678905", "012345678905", "01234567890?")
    assert [r.expiry_date for r in labels.expiry_dates(t).where("file = 'food' and expiry_date is not null").collect()] == ["2021 JA 05"]
    d = spark.createDataFrame([("water",), ("sugar",)], "word string")
    got = labels.ingredients(t, d, ["water", "sugar"], ["water", "salt", "sugar"], ["eau"], []).where("Filename in ('food', 'none')").orderBy("Filename", "ingr_string").collect()
    assert [r.ingr_string for r in got] == ["INGREDIENTS: WATER", "INGREDIENTS: WATER, SALT, SUGAR, MILK", ""]
    out = str(tmp_path / "out")
    st.run(st.stream(spark, responses), out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).where("expiry_date is not null").count() == 1


def test_passes_and_new_files(spark):
    t = spark.createDataFrame([("a", 0, None), ("a", 1, "x"), ("b", 0, "y"), ("b", 1, "z")], "file string, cutoff_no int, upc string")
    assert {r.file: r.upc for r in upc.first_cutoff(t).collect()} == {"a": "x", "b": "y"}
    assert rd.new_files(t.select("file").distinct(), t.where("file = 'a'")).first().file == "b"


def test_recogniser_errors_become_rows(spark):
    def make():
        def call(data, width, height, channels):
            if not data:
                raise ValueError("empty")
            return pd.DataFrame({"text": ["w"], "left": [1], "top": [2], "width": [3], "height": [4], "conf": [0.5]})

        return call

    t = spark.createDataFrame([("a", 1, 1, 1, bytearray(b"x")), ("b", 1, 1, 1, bytearray())], "image_id string, width int, height int, channels int, data binary")
    assert {r.image_id: (r.seq, r.text) for r in rd.recognise(t, make).collect()} == {"a": (0, "w"), "b": (-1, "empty")}


def test_pixels(spark):
    m = np.full((40, 60), 255, np.uint8)
    m[10:20, 15:30] = 0
    assert px.crop_white(m).shape == (10, 15)
    assert px.components(m == 0).max() == 1
    assert (px.close(m, 2) == m).all()
    assert (px.warp(m, np.eye(3), 0, 0, 60, 40) == m).all()
    t = spark.createDataFrame([("a", 60, 40, 1, bytearray(m.tobytes()))], "image_id string, width int, height int, channels int, data binary")
    assert tuple(im.processed(t, 30).select("width", "height").first()) == (30, 20)
    b = spark.createDataFrame([("a", 0, 15, 10, 30, 20)], "image_id string, crop int, x0 int, y0 int, x1 int, y1 int")
    assert set(im.crops(t, b).first().data) == {0}
    rule = np.full((50, 80), 255, np.uint8)
    rule[25] = 0
    assert px.table_lines(rule) == [(0, 25, 79, 25)]
    assert cv.flattened(t).first().flag in (-1, 0)


def test_conics():
    t = np.linspace(0, 2 * np.pi, 60)
    c, s = np.cos(0.4), np.sin(0.4)
    p = np.stack([100 + 40 * np.cos(t) * c - 15 * np.sin(t) * s, 50 + 40 * np.cos(t) * s + 15 * np.sin(t) * c], 1)
    for eq in (cn.fit_direct(p), cn.fit_sampson(p)):
        assert np.allclose(cn.geometric(eq), (100, 50, 40, 15, 0.4), atol=1e-3)
    assert abs(cn.distance(np.array([100.0, 50.0]), cn.implicit(100, 50, 40, 15, 0.4)) - 15) < 1e-6
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    h = cn.homography(square, square * 2 + 3)
    assert np.allclose(h, [[2, 0, 3], [0, 2, 3], [0, 0, 1]], atol=1e-8)
    for x in itertools.product(range(3), repeat=5):
        x = np.array(x)
        best = max(sum(k) for k in itertools.product((0, 1), repeat=5) if (np.diff(x[np.array(k, bool)]) <= 0).all())
        keep = cn.longest_non_increasing(x)
        assert keep.sum() == best and (np.diff(x[keep]) <= 0).all()


def test_geometry_columns(spark):
    box = lambda a, b, c, d: F.struct(F.lit(a).alias("x0"), F.lit(b).alias("y0"), F.lit(c).alias("x1"), F.lit(d).alias("y1"))
    r = spark.range(1).select(fb.union_box(box(0, 5, 2, 6), box(1, 1, 9, 2)).alias("u"), fb.direction(box(0, 0, 2, 2), box(3, 0, 4, 2)).alias("d")).first()
    assert tuple(r.u) == (0, 1, 9, 6) and r.d == "right"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(t: pd.DataFrame) -> list:
    t = t[sorted(t.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 6) if not isinstance(v, (str, bool, np.bool_)) else str(v) for v in r) for r in t.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, duck, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_large_edge_components_are_split_like_small_ones():
    from labelfacts.operators import curves

    for width in (300, 1400):
        image = np.zeros((60, width))
        image[25:36, 20 : width - 20] = 255
        found = [p for p in curves.edge_curves(image) if np.ptp(p[:, 0]) > width / 2]
        assert len(found) == 2 and all(p[:, 1].std() < 2 for p in found)

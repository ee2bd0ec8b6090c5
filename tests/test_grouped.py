"""Kernels over many groups at once give what they give for each group, and their queries call no function a group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelfacts import storage
from labelfacts.functions import conics as cn
from labelfacts.functions import text as ft
from labelfacts.operators import boxes as bx
from labelfacts.operators import facts as fc
from labelfacts.operators import words as wd
from labelfacts.plans import labels, queries
from labelfacts.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def fragments(features: int = 2) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = np.concatenate([np.arange(1, 13), rng.integers(1, 13, 200), [70]])
    return rng.integers(0, 9, (n.sum(), features)).astype(float), np.append(0, n.cumsum()[:-1])


def test_ellipses_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(1)
    t = [rng.uniform(0, 6, k) for k in (6, 9, 30, 31, 200)]
    found = [np.stack([40 * np.cos(a) + 3 * rng.normal(size=len(a)), 15 * np.sin(a) + rng.normal(size=len(a))], 1) for a in t]
    for p, eq in zip(found, cn.fit_sampson_many(found)):
        assert np.isclose((cn.sampson(eq, p) ** 2).mean(), (cn.sampson(cn.fit_sampson(p), p) ** 2).mean(), rtol=1e-5)
    assert "FlatMapGroups" not in plan(spark, "conic_fits")


def test_fragments_split_together_are_those_split_alone(spark):
    x, starts = fragments()
    want = np.concatenate([cn.split_fragment(v) for v in np.split(x, starts[1:])])
    assert (cn.split_fragments(x, starts) == want).all()
    assert "FlatMapGroups" not in plan(spark, "kmeans_fragments")


def test_lines_of_many_images_are_those_of_each(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(1, 20, 60)
    top, height, starts = rng.integers(0, 60, n.sum()), rng.integers(0, 30, n.sum()), np.append(0, n.cumsum()[:-1])

    def alone(top, height):
        line, n = np.full(len(top), -1), 0
        for i in range(len(top)):
            if line[i] < 0:
                line[i] = n
                centre = top[i] + height[i] / 2
                line[(top - 2 < centre) & (centre < top + np.where(height <= 5, height[i], height) + 2)] = n
                n += 1
        return line

    want = np.concatenate([alone(*v) for v in zip(np.split(top, starts[1:]), np.split(height, starts[1:]))])
    assert (bx.number_lines(top, height, starts, 2, 5) == want).all()
    assert "FlatMapGroups" not in plan(spark, "greedy_lines")


#: Exchanges and tables written at most, by query: words go through all their steps in one pass over each image.
ONE_PASS = {
    "conflict_aggregate": (1, 0),
    "nutrition_facts": (1, 0),
    "facts_map": (2, 0),
    "absent_marking": (1, 0),
    "facts_wide": (2, 0),
    "unique_hits": (1, 0),
    "interval_overlap_pairs": (1, 0),
    "same_line_pairs": (1, 0),
    "neighbour_rules": (1, 0),
    "exact_hits": (1, 0),
    "serving_size": (1, 0),
    "vitamin_merge": (1, 0),
    "merge_coalesce": (4, 1),
    "merge_conflicts": (4, 1),
    "value_unit_dv": (1, 0),
    "missing_facts": (1, 0),
    "right_most_name": (1, 0),
    "right_of_word": (1, 0),
    "fuzzy_hits_1": (1, 0),
}


@pytest.mark.parametrize("name", ONE_PASS)
def test_labels_are_shuffled_once(spark, name, monkeypatch):
    made = []
    for module in (queries, labels, fc):
        monkeypatch.setattr(module, "written", lambda t: made.append(t) or storage.written(t))
    exchanges, writes = ONE_PASS[name]
    assert plan(spark, name).count("Exchange") <= exchanges and len(made) <= writes


def test_words_are_told_as_by_the_column_functions(spark):
    texts = ["2,5g", "G*", "4gt", "Fiber", "Saturés(", "Sugarstt", "10Omg", "17.5mg", "a/b/c", "//", "", "1.2.3", "12", "3.", "vitamin", "vitamine", "vitamins", "vitamina", "perm", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ft.clean("t").alias("c"), ft.fix_spelling(ft.oh_to_zero("t")).alias("s"), ft.parts("t").alias("p"), ft.number("t").alias("n"), *(ft.within("t", F.lit(x), k).alias(f"{x}{k}") for x in ("vitamin", "fibre", "12") for k in (0, 1, 2))).orderBy("i").collect()
    for t, r in zip(texts, got):
        assert (wd.clean(t), wd.respelt(t), list(wd.parts(t)), wd.number(t) if wd.number(t) == wd.number(t) else None) == (r.c, r.s, r.p, r.n)
        assert all(wd.within(t, x, k) == bool(r[f"{x}{k}"]) for x in ("vitamin", "fibre", "12") for k in (0, 1, 2))


def test_only_distinct_words_are_tested_for_pruning(spark):
    steps = QUERIES["dictionary_pruned"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in steps

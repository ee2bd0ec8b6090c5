"""Typo-tolerant joins.

``phrase_hits`` joins each image's word runs with a short list of terms, folded into one expression without a join at all.
``nearest_word`` joins words with a dictionary of any size by keys instead of all pairs: words at most 2 edits apart agree on a deletion variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from .boxes import ngram

#: Terms up to which the test is written out as an expression; beyond, a broadcast table is joined.
INLINE_TERMS = 200


def phrase_hits(boxes: DataFrame, terms: list[str], most: int = 1) -> DataFrame:
    """(image_id, seq, term, found) where the run of words from seq on is at most ``most`` edits from the term; a run has as many words as the term."""
    sizes = sorted({t.count(" ") + 1 for t in terms})
    some = may_hold(boxes, terms, most)
    if some is not None:
        boxes = boxes.join(some, "image_id", "left_semi")
    runs = boxes.select("image_id", "seq", *(F.lower(ngram(n)).alias(f"n{n}") for n in sizes))
    tests = [F.when(ft.within(f"n{t.count(' ') + 1}", F.lit(t), most), F.struct(F.lit(t).alias("term"), F.col(f"n{t.count(' ') + 1}").alias("found"))) for t in terms]
    if len(terms) > INLINE_TERMS:
        table = F.broadcast(boxes.sparkSession.createDataFrame([(t, t.count(" ") + 1) for t in terms], "term string, size int"))
        long = runs.select("image_id", "seq", F.explode(F.array(*(F.struct(F.lit(n).alias("size"), F.col(f"n{n}").alias("found")) for n in sizes))).alias("r")).select("image_id", "seq", "r.*")
        return long.join(table, (table["size"] == long["size"]) & ft.within(long["found"], table["term"], most)).select("image_id", "seq", "term", "found")
    hits = runs.select("image_id", "seq", F.explode(F.filter(F.array(*tests), lambda h: h.isNotNull())).alias("h"))
    return hits.select("image_id", "seq", "h.term", "h.found")


def may_hold(boxes: DataFrame, terms: list[str], most: int) -> DataFrame | None:
    """(image_id) of the images that have as many of some term's words as a hit leaves whole: an edit spoils two words at most. None if a term asks for none."""
    words = sorted({w for t in terms for w in t.split()})
    masks, least = {w: 1 << i for i, w in enumerate(words)}, []
    for t in terms:
        n = [t.split().count(w) for w in set(t.split())]
        least.append(-(-(sum(n) - 2 * most) // max(n)))
    if len(words) > 62 or min(least) < 1:
        return None
    bit = F.create_map(*(F.lit(x) for p in masks.items() for x in p))[F.lower("text")]
    has = F.lit(False)
    for t, n in zip(terms, least):
        has = has | (F.bit_count(F.col("m").bitwiseAND(F.lit(sum(masks[w] for w in set(t.split()))))) >= n)
    return boxes.groupBy("image_id").agg(F.bit_or(F.coalesce(bit, F.lit(0)).cast("long")).alias("m")).where(has).select("image_id")


def edge_hits(boxes: DataFrame, terms: list[str]) -> DataFrame:
    """(image_id, seq, term) where a word starts or ends with the term."""
    tests = F.array(*(F.when(ft.starts_or_ends(F.lower("text"), F.lit(t)), F.lit(t)) for t in terms))
    return boxes.select("image_id", "seq", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("term"))


def unique_hits(hits: DataFrame) -> DataFrame:
    """(image_id, term, seq) of terms with exactly one hit in their image."""
    return hits.groupBy("image_id", "term").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n = 1").select("image_id", "term", "seq")


def deletions(word: Column, most: int = 2) -> Column:
    """Array of the word and all it becomes when up to ``most`` letters are taken out. Two words within that many edits share one."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
    return out


def candidates(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, near, distance) of every distinct word and each dictionary word within ``most`` edits. An equi-join on deletion variants."""
    left = words.select("word").distinct().withColumn("k", F.explode(deletions(F.col("word"), most)))
    right = dictionary.select(F.col("word").alias("near")).distinct().withColumn("k", F.explode(deletions(F.col("near"), most)))
    met = left.join(right, "k").select("word", "near").distinct()
    return met.withColumn("distance", F.levenshtein("word", "near", most)).where("distance >= 0")


def nearest_word(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, correction, distance) of words with a single nearest dictionary word; a tie corrects nothing."""
    best = candidates(words, dictionary, most).withColumn("s", F.struct("distance", "near"))
    ranked = best.groupBy("word").agg(F.min("s").alias("b"), F.collect_list("distance").alias("d"))
    alone = F.size(F.filter("d", lambda x: x == F.col("b.distance"))) == 1
    return ranked.where(alone).select("word", F.col("b.near").alias("correction"), F.col("b.distance").alias("distance"))


def prune(dictionary: DataFrame, discard: list[str], most: int = 1) -> DataFrame:
    """Dictionary words that aren't within ``most`` edits of a discarded one."""
    near = F.lit(False)
    for w in discard:
        near = near | ft.within("word", F.lit(w), most)
    return dictionary.where(~near)


def only_before(first: DataFrame, second: DataFrame, dictionary: DataFrame, least: int = 3) -> DataFrame:
    """(image_id, word): dictionary words of the first recognition that the second one no longer has."""
    known = dictionary.where(F.length("word") >= least)
    pick = lambda b: b.select("image_id", ft.process_str("text").alias("word")).join(known, "word", "left_semi").distinct()
    return pick(first).join(pick(second), ["image_id", "word"], "left_anti")

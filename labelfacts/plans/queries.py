"""One query an operator over the driver's tables, and the SQL that gives the same rows in DuckDB.

Tables of labels don't exist there; they are derived from whole tables: each order becomes a label with a printed line for each of its lines
(sources.readers.label_lines), each document a page of words. Nothing is cut to an id range or a number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as fb
from ..functions import text as ft
from ..operators import annotations as an
from ..operators import boxes as bx
from ..operators import curves as cv
from ..operators import facts as fc
from ..operators import fuzzy as fz
from ..operators import ingredients as ig
from ..operators import lines as ln
from ..operators import upc
from ..operators import words as wd
from ..sources import readers as rd
from ..storage import written
from ..vocabulary import AMOUNT_ONLY, DISCARD, FOOTERS, FOREIGN, FRENCH, NEW_FORMAT, NEW_FORMAT_DISTANCE, SHORT, TERMS, WHOLE
from . import labels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PHRASES = ["sugars alcohols", "teneur de la", "total fat", "vitamin a"]
EDGES = ["ing", "ment", "pre", "sch", "th"]
ENGLISH = sorted("the and that with for this from have will under over their which were".split())
FRENCH_WORDS = sorted("le la les des est dans pour avec une sur aux que qui du".split())
STOP = ["a", "de", "en", "on"]
DROPPED = "vitamin e"


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None, after: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL behind the CTEs named."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(f'{k} AS ({CTE[k]})' for k in _needed(after))} " if after else "") + sql
        return f

    return add


_WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_LEFT = "CAST(10 * coalesce(sum(length(text) + 1) OVER (PARTITION BY {0}, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS \"left\""
_NUMBER = "TRY_CAST(CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN {0} ELSE nullif(regexp_extract({0}, '^([0-9]+\\.[0-9]+)', 1), '') END AS DOUBLE)"
_GRAM = "rtrim(array_to_string(list(text) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING), ' '))"
_RENUMBER = "CAST(row_number() OVER (PARTITION BY image_id ORDER BY {0}) - 1 AS INT) AS seq"
_ON_LINE = "i.top + i.height / 2 > j.top - 2 AND i.top + i.height / 2 < j.top + CASE WHEN j.height <= 5 THEN i.height ELSE j.height END + 2"
_OVERLAP = "((i.top + i.height - j.top > 0.1 * j.height AND i.top < j.top + j.height) OR (j.top + j.height - i.top > 0.1 * j.height AND j.top < i.top + i.height))"


def _fixed(t: str) -> str:
    for a, b in (("é", "e"), ("*", ""), ("gt", "g"), ("gf", "g"), ("sugarstt", "sugars"), ("sugarst", "sugars"), ("sucrestt", "sucres"), ("sucrest", "sucres"), (" ", ""), ("(", ""), (")", "")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


_CLEAN = _fixed("lower(CASE WHEN regexp_matches(text, '^[0-9]+,[0-9]+') THEN replace(text, ',', '.') ELSE text END)")
_OH = "CASE WHEN regexp_matches(text, '^[0-9]*[Oo](mg|g)') THEN '0g' ELSE text END"
_SPELL = f"replace(replace({_OH}, 'fiber', 'fibre'), 'satures', 'sature')"
_FOOT = " OR ".join(f"(levenshtein(lower(n{p.count(' ') + 1}), '{p}') <= 1)" for p in FOOTERS)
_VITAMIN = "(levenshtein({0}, 'vitamin') <= 1 OR levenshtein({0}, 'vitamine') <= 1)"
_STATUS = "CASE WHEN min({0}) = max({0}) THEN 'ok' WHEN min({0}) IS NOT NULL THEN 'conflict' END"
_SINGLE = "CASE WHEN min({0}) = max({0}) THEN min({0}) END"
_ITEM = "items[CAST(p0 + {0} + 1 AS INT)]"
_AFTER = "items[CAST(p0 + s + {0} + 1 AS INT)]"

_SAME = "(levenshtein({0}, {1}) <= 1 AND (NOT contains({1}, 'vitamin') OR right({0}, 1) = right({1}, 1)))"


def _vitamins(source: str, p: str) -> dict[str, str]:
    """CTEs that merge a vitamin and its letter, the last of them <p>vm."""
    return {
        f"{p}fo_v": f"SELECT *, {_VITAMIN.format('text')} AS v, lead(text) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(width) OVER w AS w1, lead(width, 2) OVER w AS w2 FROM {source} WINDOW w AS (PARTITION BY image_id ORDER BY seq)",
        f"{p}fo_t": f"SELECT *, coalesce(CASE WHEN v AND length(t1) <= 2 AND t1 <> '/' AND NOT {_VITAMIN.format('t1')} THEN CASE WHEN t1 = 'b' AND regexp_matches(t2, '^[0-9]+$') THEN 2 ELSE 1 END ELSE 0 END, 0) AS take FROM {p}fo_v",
        f"{p}vm": f"""SELECT image_id, {_RENUMBER.format('seq')}, CASE take WHEN 2 THEN concat_ws(' ', text, t1, t2) WHEN 1 THEN concat_ws(' ', text, t1) ELSE text END AS text, "left", top,
            CAST(width + CASE WHEN take >= 1 THEN w1 ELSE 0 END + CASE WHEN take = 2 THEN w2 ELSE 0 END AS INT) AS width, height
            FROM (SELECT *, coalesce(lag(take) OVER w, 0) >= 1 OR coalesce(lag(take, 2) OVER w, 0) >= 2 AS gone FROM {p}fo_t WINDOW w AS (PARTITION BY image_id ORDER BY seq)) WHERE NOT gone""",
    }


def _foreign(source: str, p: str) -> dict[str, str]:
    """CTEs of labels of the other format, the last of them <p>foreign_."""
    return {
        f"{p}fh": f"SELECT image_id, seq, top, height, text AS term FROM {source} WHERE text IN ({_list(FOREIGN)})",
        f"{p}foreign_": f"""SELECT i.image_id, count(DISTINCT i.term) AS terms FROM (SELECT * FROM {p}fh QUALIFY seq = min(seq) OVER (PARTITION BY image_id, term)) i JOIN {p}fh j ON i.image_id = j.image_id AND i.term <> j.term AND {_ON_LINE}
            GROUP BY i.image_id HAVING count(DISTINCT i.term) >= 3""",
    }


CTE = {
    "docl": "SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
    "docw": f"SELECT doc_id AS image_id, line_no, unnest(range(len(a))) AS word_no, unnest(a) AS text FROM (SELECT doc_id, line_no, {_WORDS.format('line')} AS a FROM docl)",
    "docb": f"SELECT image_id, {_RENUMBER.format('line_no, word_no')}, CAST(line_no AS INT) AS line_no, text, {_LEFT.format('image_id')}, CAST(20 * line_no AS INT) AS top, CAST(10 * length(text) AS INT) AS width, 14 AS height FROM docw",
    "ll": f"""SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INT) AS line_no,
        ([{_list(rd.PRINTED)}])[l_partkey % {len(rd.PRINTED)} + 1] || ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE l_suppkey % 7 WHEN 0 THEN ',5g' WHEN 1 THEN 'Omg' WHEN 2 THEN 'mg' WHEN 3 THEN 'gt' WHEN 4 THEN ' g' WHEN 5 THEN '' ELSE 'G' END
        || CASE WHEN l_tax >= 0.04 THEN ' ' || CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || ' %' ELSE '' END AS text FROM lineitem""",
    "lw": f"SELECT image_id, line_no, unnest(range(len(a))) AS word_no, unnest(a) AS text FROM (SELECT image_id, line_no, {_WORDS.format('text')} AS a FROM ll)",
    "lb": f"SELECT image_id, {_RENUMBER.format('line_no, word_no')}, text, {_LEFT.format('image_id')}, CAST(40 * line_no AS INT) AS top, CAST(10 * length(text) AS INT) AS width, 20 AS height FROM lw",
    "c1": f"SELECT * REPLACE ({_CLEAN} AS text) FROM lb",
    "c2": f"SELECT *, {', '.join(f'{_GRAM.format(n - 1)} AS n{n}' for n in sorted({p.count(' ') + 1 for p in FOOTERS}))} FROM c1",
    "c3": f"SELECT image_id, seq, text, \"left\", top, width, height FROM (SELECT *, min(CASE WHEN {_FOOT} THEN seq END) OVER (PARTITION BY image_id) AS cut FROM c2) WHERE cut IS NULL OR seq < cut",
    "c4": f"""SELECT image_id, {_RENUMBER.format('seq')}, text, "left", top, width, height FROM (SELECT *, min(CASE WHEN h THEN seq END) OVER (PARTITION BY image_id, top) AS cut FROM
        (SELECT *, text = 'calories' AND lead(text) OVER (PARTITION BY image_id, top ORDER BY seq) = 'from' AS h FROM c3)) WHERE cut IS NULL OR seq < cut""",
    "c5": f"SELECT * REPLACE ({_SPELL} AS text) FROM c4",
    "c6": r"SELECT *, list_filter(regexp_extract_all(text, '(\d+\.*\d*|[^\d]+)', 1), lambda x: x <> '') AS n, list_filter(string_split(text, '/'), lambda x: x <> '') AS s FROM c5",
    "c7": "SELECT image_id, seq, text, \"left\", top, width, height, unnest(range(len(p))) AS i, unnest(p) AS t FROM (SELECT *, CASE WHEN len(n) > 1 THEN n WHEN len(s) > 1 THEN s ELSE [text] END AS p FROM c6)",
    "c8": "SELECT *, CAST(floor(length(t) / length(text) * width) AS INT) AS share FROM c7",
    "c9": f"SELECT image_id, {_RENUMBER.format('seq, i')}, t AS text, CAST(\"left\" + coalesce(sum(share) OVER (PARTITION BY image_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS \"left\", top, share AS width, height FROM c8",
    "cw": f"SELECT * REPLACE ({_RENUMBER.format('seq').removesuffix(' AS seq')} AS seq) FROM c9 WHERE text NOT IN ('', ' ')",
    "terms": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{FRENCH[t]}', {repr(SHORT[t][0]) if t in SHORT else 'NULL'})" for t in TERMS) + ") v(term, fr, short)",
    "names": "SELECT term, term AS name, 0 AS f FROM terms UNION ALL SELECT term, fr, 1 FROM terms WHERE fr <> term UNION ALL SELECT term, short, 2 FROM terms WHERE short IS NOT NULL",
    "gram": f"SELECT image_id, seq, lower(text) AS n1, lower({_GRAM.format(1)}) AS n2 FROM cw",
    **_vitamins("cw", ""),
    "ms": f"SELECT *, coalesce(text || lead(text) OVER w IN ({_list(WHOLE)}), false) AS f, lead(text) OVER w AS t1, lead(width) OVER w AS w1 FROM vm WINDOW w AS (PARTITION BY image_id ORDER BY seq)",
    "mt": "SELECT *, f AND (seq - coalesce(max(CASE WHEN NOT f THEN seq END) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) % 2 = 1 AS m FROM ms",
    "mw": f"""SELECT image_id, {_RENUMBER.format('seq')}, CASE WHEN m THEN text || ' ' || t1 ELSE text END AS text, "left", top, CAST(width + CASE WHEN m THEN w1 ELSE 0 END AS INT) AS width, height
        FROM (SELECT *, coalesce(lag(m) OVER w, false) AS gone FROM mt WINDOW w AS (PARTITION BY image_id ORDER BY seq)) WHERE NOT gone""",
    "hit": f"SELECT image_id, seq, term AS nutrient, f FROM (SELECT image_id, seq, lower(text) AS w FROM mw), names WHERE {_SAME.format('w', 'name')}",
    "hits": "SELECT image_id, nutrient, seq FROM hit QUALIFY f = min(f) OVER (PARTITION BY image_id, nutrient)",
    "nb": "SELECT *, lag(text) OVER w AS before, lag(text, 2) OVER w AS two, lead(text) OVER w AS after FROM mw WINDOW w AS (PARTITION BY image_id ORDER BY seq)",
    "hn": "SELECT h.image_id, nutrient, h.seq, top AS line, before, after, after IS NULL AS last FROM hits h JOIN nb USING (image_id, seq)",
    "hm": "SELECT *, count(*) OVER n > 1 AND min(line) OVER n <> max(line) OVER n AS many, min(seq) OVER n AS first, max(CAST(last AS INT)) OVER n = 1 AS ends FROM hn WINDOW n AS (PARTITION BY image_id, nutrient)",
    "hk": """SELECT *, CASE WHEN nutrient IN ('fat', 'sugars', 'carbohydrate') AND coalesce(before = 'total', false) THEN 0
            WHEN nutrient = 'fat' AND NOT coalesce(contains(before, 'saturated'), false) THEN 1 WHEN nutrient = 'fat' THEN 2
            WHEN nutrient IN ('sugars', 'carbohydrate') THEN 1
            WHEN nutrient = 'fibre' AND (coalesce(contains(before, 'soluble'), false) OR coalesce(contains(after, 'soluble'), false)) THEN 1 ELSE 0 END AS r
        FROM hm WHERE many AND NOT (nutrient = 'sugars' AND (ends OR coalesce(after = 'alcohols', false)))""",
    "chosen": "SELECT image_id, nutrient, seq FROM hm WHERE NOT many AND seq = first UNION ALL SELECT image_id, nutrient, seq FROM (SELECT * FROM hk QUALIFY r = min(r) OVER (PARTITION BY image_id, nutrient))",
    "serving": """SELECT image_id, 'portion_size' AS nutrient, seq FROM nb WHERE
        (regexp_matches(text, '^(per|pour|par)|(per|pour|par)$') AND text <> 'copper' AND coalesce(before <> 'amount', true))
        OR ((levenshtein(text, 'serving') <= 1 OR levenshtein(text, 'portion') <= 1) AND coalesce(before <> 'per', true) AND coalesce(two <> 'amount', true))""",
    "seed": "SELECT c.*, top, height, \"left\" FROM (SELECT * FROM chosen UNION ALL SELECT * FROM serving) c JOIN mw USING (image_id, seq)",
    "li": f"""SELECT i.image_id, i.nutrient, i.seq, list(j.text ORDER BY j."left" - i."left", j.seq) AS items FROM seed i JOIN mw j
        ON i.image_id = j.image_id AND j."left" >= i."left" AND CASE WHEN i.nutrient IN ('saturated', 'trans') THEN {_OVERLAP} ELSE {_ON_LINE} END GROUP BY i.image_id, i.nutrient, i.seq""",
    "la": f"""SELECT *, CASE WHEN nutrient = 'portion_size' THEN list_min(list_transform(list_filter(range(1, len(items) + 1), lambda i: i >= 2 AND regexp_matches(items[i], '^[0-9]+') AND coalesce(items[i + 1] IN ('g', 'ml'), false)), lambda i: i - 2))
        ELSE coalesce(greatest({', '.join(f"list_max(list_filter(range(0, len(items)), lambda i: {_SAME.format('items[i + 1]', n)}))" for n in ('term', 'fr'))}), list_max(list_filter(range(0, len(items)), lambda i: short IS NOT NULL AND {_SAME.format('items[i + 1]', 'short')}))) END AS p0
        FROM li LEFT JOIN terms ON nutrient = term""",
    "ls": f"SELECT *, CASE WHEN {_NUMBER.format(_ITEM.format(1))} IS NOT NULL THEN 1 WHEN {_NUMBER.format(_ITEM.format(2))} IS NOT NULL THEN 2 END AS s FROM la WHERE p0 IS NOT NULL",
    "lv": f"""SELECT image_id, nutrient, seq, {_NUMBER.format(_AFTER.format(0))} AS value, CASE WHEN {_AFTER.format(1)} IN ('g', 'mg', 'ml', 'ug') THEN {_AFTER.format(1)} END AS unit, s, {_AFTER.format(1)} AS w1, {_AFTER.format(2)} AS w2,
        nutrient IN ({_list(AMOUNT_ONLY)}) AS only_amount FROM ls""",
    "vals": f"""SELECT image_id, nutrient, CASE WHEN NOT share THEN value END AS quantity, CASE WHEN s IS NOT NULL THEN CASE WHEN nutrient = 'calories' THEN 'kcal' ELSE unit END END AS unit,
        CASE WHEN only_amount THEN NULL WHEN share THEN value WHEN unit IS NOT NULL THEN {_NUMBER.format('w2')} WHEN w2 = '%' THEN {_NUMBER.format('w1')} END AS dv
        FROM (SELECT *, NOT only_amount AND unit IS NULL AND coalesce(w1 = '%', false) AS share FROM lv)""",
    "fx": f"""SELECT image_id, nutrient, {_SINGLE.format('quantity')} AS quantity, {_STATUS.format('quantity')} AS quantity_status, CASE WHEN {_STATUS.format('unit')} = 'conflict' THEN 'conflict' ELSE {_SINGLE.format('unit')} END AS unit,
        {_SINGLE.format('dv')} AS dv, CASE WHEN nutrient IN ({_list(AMOUNT_ONLY)}) THEN 'blank' ELSE {_STATUS.format('dv')} END AS dv_status FROM vals GROUP BY image_id, nutrient""",
    **_foreign("vm", ""),
    "pl": f"SELECT image_id, line_no, ([{_list(FOREIGN)}])[(image_id + line_no) % {len(FOREIGN)} + 1] || ' 2 % ' || ([{_list(FOREIGN)}])[(image_id + 3 * line_no) % {len(FOREIGN)} + 1] || ' 4 %' AS text FROM ll",
    "pw": f"SELECT image_id, line_no, unnest(range(len(a))) AS word_no, unnest(a) AS text FROM (SELECT image_id, line_no, {_WORDS.format('text')} AS a FROM pl)",
    "pb": f"SELECT image_id, {_RENUMBER.format('line_no, word_no')}, text, {_LEFT.format('image_id')}, CAST(40 * line_no AS INT) AS top, CAST(10 * length(text) AS INT) AS width, 20 AS height FROM pw",
    **_vitamins("pb", "p"), **_foreign("pvm", "p"),
    "every": f"SELECT image_id, term AS nutrient FROM (SELECT DISTINCT image_id FROM fx WHERE nutrient <> '{DROPPED}' AND image_id NOT IN (SELECT image_id FROM foreign_)), terms WHERE term <> '{DROPPED}'",
    "done": f"SELECT e.image_id, e.nutrient, quantity, quantity_status, unit, dv, dv_status FROM every e LEFT JOIN fx USING (image_id, nutrient) UNION ALL SELECT image_id, nutrient, quantity, quantity_status, unit, dv, dv_status FROM fx WHERE nutrient = 'portion_size' AND image_id NOT IN (SELECT image_id FROM foreign_)",
    "gone": "SELECT d.*, quantity_status IS NULL AND unit IS NULL AND (dv_status IS NULL OR dv_status = 'blank') AND first IS NULL AS gone FROM done d LEFT JOIN (SELECT image_id, nutrient, min(seq) AS first FROM hits GROUP BY 1, 2) USING (image_id, nutrient)",
    "absent": f"""SELECT image_id, nutrient, quantity, CASE WHEN gone THEN 'absent' ELSE quantity_status END AS quantity_status, CASE WHEN gone THEN 'absent' ELSE unit END AS unit, dv,
        CASE WHEN gone AND nutrient NOT IN ({_list(AMOUNT_ONLY)}) THEN 'absent' ELSE dv_status END AS dv_status FROM gone""",
    "long": f"SELECT image_id, {_GRAM.format(13)} AS n14, {_GRAM.format(11)} AS n12 FROM mw",
    "fresh": "SELECT image_id FROM absent WHERE nutrient IN ('potassium', 'iron', 'calcium') AND unit = 'mg' UNION SELECT image_id FROM long WHERE " + " OR ".join(f"levenshtein({_GRAM_N}, '{p}') <= {NEW_FORMAT_DISTANCE}" for p in NEW_FORMAT for _GRAM_N in [f"n{p.count(' ') + 1}"]),
    "facts_": f"""SELECT image_id, nutrient, CASE WHEN no_amount THEN NULL ELSE quantity END AS quantity, CASE WHEN no_amount THEN 'absent' ELSE quantity_status END AS quantity_status, CASE WHEN no_amount THEN 'absent' ELSE unit END AS unit,
        CASE WHEN no_dv THEN NULL ELSE dv END AS dv, CASE WHEN no_dv THEN 'absent' ELSE dv_status END AS dv_status
        FROM (SELECT *, CASE WHEN is_new THEN nutrient = 'carbohydrate' ELSE nutrient = 'sugars' END AS no_dv, NOT is_new AND nutrient IN ({_list([n for n in TERMS if n.startswith('vitamin') or n in ('iron', 'calcium', 'phosphorus', 'magnesium', 'zinc', 'potassium')])}) AS no_amount
        FROM (SELECT *, image_id IN (SELECT image_id FROM fresh) AS is_new FROM absent))""",
    "bars": """SELECT o_orderkey AS file, unnest(range(6)) AS pos, CASE unnest(range(6)) WHEN 0 THEN CASE WHEN o_custkey % 3 = 0 THEN left_ || ' ' || a || ' ' || b || ' ' || right_ ELSE a || b END
            WHEN 1 THEN 'Item' WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN a || '-' || b ELSE a END WHEN 3 THEN b WHEN 4 THEN CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE left_ END ELSE right_ END AS text
        FROM (SELECT *, CAST(o_custkey % 10 AS VARCHAR) AS left_, CAST(o_orderkey % 7 AS VARCHAR) AS right_, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS a, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS b FROM orders)""",
    "chat": "SELECT conv_id AS file, turn AS pos, text, role = 'user' AS h, " + " OR ".join(f"contains(lower(text), '{w}')" for w in FRENCH_WORDS[:6]) + " AS w FROM conversations",
    "toks": "SELECT key, unnest(range(len(a))) AS pos, unnest(a) AS token FROM (SELECT conv_id || ':' || turn AS key, list_filter(regexp_extract_all(t, '[,.;: ()]|[^,.;: ()]+'), lambda x: x <> '') AS a FROM (SELECT *, regexp_replace(text, '[^ -~]+', '', 'g') AS t FROM conversations) WHERE t <> '')",
    "lexicon": r"SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' ')) AS word FROM benchmark) WHERE length(word) >= 5",
    "printed": r"SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' ')) AS word FROM conversations) WHERE length(word) >= 5",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    """The CTEs that these read, in order."""
    import re

    want, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in want:
            want.add(n)
            todo += [k for k in CTE if k != n and re.search(rf"\b{k}\b", CTE[n])]
    return [k for k in CTE if k in want]


def _lines(s: SparkSession, d: str) -> DataFrame:
    return rd.label_lines(_table(s, d, "lineitem"))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return rd.label_boxes(_lines(s, d))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return rd.boxes_from_text(_table(s, d, "documents"), "doc_id")


def _ascii_words(table: DataFrame) -> DataFrame:
    words = F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]+", " ")), " ")).alias("word")
    return table.select(words).where(F.length("word") >= 5).distinct()


@query("SELECT * FROM facts_", after=("facts_",))
def nutrition_facts(s, d):
    return labels.nutrition_facts(_lines(s, d))


@query("SELECT * FROM docb", after=("docb",))
def word_boxes(s, d):
    return _pages(s, d)


@query("SELECT image_id, seq, text FROM c1", after=("c1",))
def clean_text(s, d):
    return _labels(s, d).select("image_id", "seq", ft.clean("text").alias("text"))


@query("SELECT image_id, line_no, CASE WHEN regexp_matches(word, '^[0-9]+,[0-9]+') THEN replace(word, ',', '.') ELSE word END AS text FROM (SELECT image_id, line_no, unnest(string_split(text, ' ')) AS word FROM ll) WHERE contains(word, ',')", after=("ll",))
def french_floats(s, d):
    return rd.label_lines(_table(s, d, "lineitem")).select("image_id", "line_no", F.explode(F.split("text", " ")).alias("w")).where(F.col("w").contains(",")).select("image_id", "line_no", ft.french_floats("w").alias("text"))


@query(f"SELECT image_id, seq, {_OH} AS text FROM lb", after=("lb",))
def oh_to_zero(s, d):
    return _labels(s, d).select("image_id", "seq", ft.oh_to_zero("text").alias("text"))


@query("SELECT image_id, seq, replace(replace(lower(text), 'fiber', 'fibre'), 'satures', 'sature') AS text FROM lb", after=("lb",))
def spelling_fix(s, d):
    return _labels(s, d).select("image_id", "seq", ft.fix_spelling(F.lower("text")).alias("text"))


@query("SELECT * FROM c9", after=("c9",))
def split_numbers(s, d):
    t = bx.calories_from(bx.drop_below(_labels(s, d).withColumn("text", ft.clean("text"))), "top")
    return bx.split_items(t.withColumn("text", ft.fix_spelling(ft.oh_to_zero("text"))))


@query(f"SELECT image_id, {_RENUMBER.format('seq')}, text FROM (SELECT image_id, seq, replace(text, '*', '') AS text FROM lb) WHERE text NOT IN ('', ' ')", after=("lb",))
def blank_removal(s, d):
    return bx.drop_blank(_labels(s, d).select("image_id", "seq", F.replace("text", F.lit("*"), F.lit("")).alias("text")))


@query("SELECT * FROM c3", after=("c3",))
def drop_below_phrase(s, d):
    return bx.drop_below(_labels(s, d).withColumn("text", ft.clean("text")))


@query("SELECT * FROM c4", after=("c4",))
def calories_from(s, d):
    return bx.calories_from(bx.drop_below(_labels(s, d).withColumn("text", ft.clean("text"))), "top")


@query("SELECT * FROM cw", after=("cw",))
def clean_up(s, d):
    return bx.clean_up(_lines(s, d))


@query("SELECT image_id, seq, term, n1 AS found FROM gram, terms WHERE NOT contains(term, ' ') AND levenshtein(n1, term) <= 1", after=("gram", "terms"))
def fuzzy_hits_1(s, d):
    return labels.phrase_hits(_lines(s, d), [t for t in TERMS if " " not in t], steps=(wd.clean_up,))


@query(f"SELECT image_id, seq, term, n AS found FROM (SELECT image_id, seq, lower({_GRAM.format(1)}) AS n2, lower({_GRAM.format(2)}) AS n3 FROM lb), (SELECT unnest([{_list(PHRASES)}]) AS term), LATERAL (SELECT CASE WHEN term = 'teneur de la' THEN n3 ELSE n2 END AS n) WHERE levenshtein(n, term) <= 1", after=("lb",))
def ngram_hits(s, d):
    return fz.phrase_hits(_labels(s, d), PHRASES)


@query(f"SELECT image_id, seq, term FROM docb, (SELECT unnest([{_list(EDGES)}]) AS term) WHERE starts_with(lower(text), term) OR ends_with(lower(text), term)", after=("docb",))
def start_end_hits(s, d):
    return fz.edge_hits(_pages(s, d), EDGES)


@query("SELECT image_id, term, min(seq) AS seq FROM gram, terms WHERE levenshtein(CASE WHEN contains(term, ' ') THEN n2 ELSE n1 END, term) <= 1 GROUP BY image_id, term HAVING count(*) = 1", after=("gram", "terms"))
def unique_hits(s, d):
    return labels.phrase_hits(_lines(s, d), TERMS, steps=(wd.clean_up,), unique=True)


def _listed(condition: str) -> str:
    return f"""SELECT i.image_id, i.seq AS i, string_agg(j.seq || ':' || (j."left" - i."left"), ' ' ORDER BY j."left" - i."left", j.seq) AS pairs FROM lb i JOIN lb j ON i.image_id = j.image_id AND {condition} GROUP BY i.image_id, i.seq"""


@query(_listed(_ON_LINE), after=("lb",))
def same_line_pairs(s, d):
    return labels.listed_pairs(_lines(s, d), wd.on_line)


@query(_listed(_OVERLAP), after=("lb",))
def interval_overlap_pairs(s, d):
    return labels.listed_pairs(_lines(s, d), wd.overlapping)


@query(_listed(_ON_LINE + ' AND j."left" >= i."left"'), after=("lb",))
def right_of_word(s, d):
    return labels.listed_pairs(_lines(s, d), lambda w, i, j: wd.on_line(w, i, j) & (w.left[j] >= w.left[i]))


@query("SELECT image_id, CAST(trunc(min(\"left\" + width / 2)) AS INT) AS x0, CAST(trunc(min(top + height / 2)) AS INT) AS y0, CAST(trunc(max(\"left\" + width / 2)) AS INT) AS x1, CAST(trunc(max(top + height / 2)) AS INT) AS y1 FROM docb GROUP BY image_id", after=("docb",))
def aabb_per_doc(s, d):
    return bx.centre_box(_pages(s, d))


@query("SELECT image_id, seq, text, CAST(\"left\" + 5 AS INT) AS \"left\", CAST(top + 5 AS INT) AS top, CAST(greatest(width - 10, 1) AS INT) AS width, CAST(greatest(height - 10, 1) AS INT) AS height FROM lb WHERE length(text) >= 3", after=("lb",))
def trimmed_boxes(s, d):
    return bx.trimmed(_labels(s, d))


@query("SELECT * FROM chosen", after=("chosen",))
def neighbour_rules(s, d):
    return labels.nutrient_hits(_lines(s, d))


@query("SELECT * FROM hits", after=("hits",))
def translated_hits(s, d):
    return labels.nutrient_hits(_lines(s, d), chosen=False)


@query("SELECT * FROM vm", after=("vm",))
def vitamin_merge(s, d):
    return bx.stepped(_lines(s, d), *labels.MERGED[:2])


@query("SELECT image_id, seq, CAST(p0 AS INT) AS \"at\" FROM la WHERE nutrient = 'portion_size' AND p0 IS NOT NULL", after=("la",))
def serving_size(s, d):
    return labels.serving_sizes(_lines(s, d))


@query("SELECT * FROM vals", after=("vals",))
def value_unit_dv(s, d):
    return labels.values(_lines(s, d))


@query("SELECT * FROM fx", after=("fx",))
def conflict_aggregate(s, d):
    return labels.facts(_lines(s, d))


@query(
    """SELECT a.image_id, a.nutrient, CASE WHEN a.quantity_status IS NULL THEN b.quantity ELSE a.quantity END AS quantity, coalesce(a.quantity_status, b.quantity_status) AS quantity_status,
    coalesce(a.unit, b.unit) AS unit, CASE WHEN a.dv_status IS NULL THEN b.dv ELSE a.dv END AS dv, coalesce(a.dv_status, b.dv_status) AS dv_status
    FROM fx a LEFT JOIN (SELECT * REPLACE (image_id + 1 AS image_id) FROM fx WHERE nutrient <> 'portion_size') b USING (image_id, nutrient)""", after=("fx",))  # fmt: skip
def merge_coalesce(s, d):
    found = written(labels.facts(_lines(s, d)))
    return fc.merge(found, found.withColumn("image_id", F.col("image_id") + 1))


@query("SELECT * FROM absent", after=("absent",))
def absent_marking(s, d):
    return labels.facts(_lines(s, d), [t for t in TERMS if t != DROPPED], labels.OWN, absent=True)


@query("SELECT image_id, terms FROM pforeign_", after=("pforeign_",))
def american_reject(s, d):
    return fc.foreign_labels(bx.merge_vitamins(rd.label_boxes(rd.paired_lines(_table(s, d, "lineitem"), FOREIGN))))


@query("SELECT * FROM mw", after=("mw",))
def vocabulary_merge(s, d):
    return bx.stepped(_lines(s, d), *labels.MERGED)


@query("SELECT * FROM fx WHERE quantity_status IS NULL OR quantity_status = 'conflict' OR (nutrient <> 'calories' AND (unit IS NULL OR unit = 'conflict'))", after=("fx",))
def missing_facts(s, d):
    return fc.missing(labels.facts(_lines(s, d)))


@query(
    """SELECT file, min(pos) AS first, string_agg(text, ', ' ORDER BY pos) AS ingr_string FROM (SELECT *, sum(CAST(h OR NOT w AS INT)) OVER (PARTITION BY file ORDER BY pos) AS g FROM chat)
    GROUP BY file, g HAVING arg_min(h AND w, pos)""", after=("chat",))  # fmt: skip
def ingredient_islands(s, d):
    chat = _table(s, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), "role", "text")
    return ig.islands(chat, F.col("role") == "user", ig.contains_word("text", FRENCH_WORDS[:6]))


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(trim(lower(regexp_replace(text, '[^A-Za-z éèêâ]+', '', 'g'))), ' ')) AS word FROM documents) WHERE length(word) >= 5")
def dictionary_words(s, d):
    return rd.dictionary(_table(s, d, "documents"), "text")


@query(f"SELECT word FROM (SELECT DISTINCT lower(p_name[1:strpos(p_name, ' ') - 1]) AS word FROM part UNION SELECT DISTINCT replace(text, '*', '') FROM c1) WHERE NOT ({' OR '.join(f'''levenshtein(word, '{w}') <= 1''' for w in DISCARD)})", after=("c1",))
def dictionary_pruned(s, d):
    first = _table(s, d, "part").select(F.lower(F.expr("substring(p_name, 1, instr(p_name, ' ') - 1)")).alias("word"))
    printed = written(_labels(s, d).select("text").distinct())  # written: else Spark tests each word on its way, not each distinct one
    return fz.prune(first.union(printed.select(ft.clean("text"))).distinct(), DISCARD)


@query(
    """SELECT word, correction, CAST(distance AS INT) AS distance FROM (SELECT p.word, arg_min(l.word, (levenshtein(p.word, l.word), l.word)) AS correction, min(levenshtein(p.word, l.word)) AS distance,
    list(levenshtein(p.word, l.word)) AS ds FROM printed p JOIN lexicon l ON abs(length(p.word) - length(l.word)) <= 2 AND levenshtein(p.word, l.word) <= 2 GROUP BY p.word)
    WHERE len(list_filter(ds, lambda x: x = distance)) = 1""", after=("printed", "lexicon"))  # fmt: skip
def spell_correct_unique(s, d):
    return fz.nearest_word(_ascii_words(_table(s, d, "conversations")), _ascii_words(_table(s, d, "benchmark")))


@query(
    f"""SELECT doc_id, CASE WHEN n = 0 THEN 'unclear' WHEN en < n / 2 AND fr < n / 2 THEN 'unclear' WHEN en > fr THEN 'en' WHEN fr > en THEN 'fr' ELSE 'unclear' END AS language FROM
    (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ({_list(ENGLISH)}))) AS en, len(list_filter(w, lambda x: x IN ({_list(FRENCH_WORDS)}))) AS fr FROM
    (SELECT doc_id, list_filter(flatten(list_transform(regexp_split_to_array(text, '[,.;:]'), lambda p: string_split(lower(trim(regexp_replace(p, '[^A-Za-z éèêâ]+', '', 'g'))), ' '))), lambda x: x <> '' AND x NOT IN ({_list(STOP)})) AS w FROM documents))""")  # fmt: skip
def language_by_lexicon(s, d):
    return ig.with_language(_table(s, d, "documents").select("doc_id", "text"), "text", ENGLISH, FRENCH_WORDS, STOP).select("doc_id", "language")


@query("SELECT item_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS word FROM (SELECT item_id, list_filter(flatten(list_transform(regexp_split_to_array(text, '[,.;:]'), lambda p: string_split(lower(trim(regexp_replace(p, '[^A-Za-z éèêâ]+', '', 'g'))), ' '))), lambda x: x <> '') AS w FROM benchmark)")
def split_to_words(s, d):
    return _table(s, d, "benchmark").select("item_id", F.posexplode(ft.split_to_words("text")).alias("pos", "word"))


@query(
    """SELECT o_orderkey, coalesce(nullif(regexp_extract(t, '(20[0-9]{2}[ :/]{0,1}[A-Z]{2,3}[ :/]{0,1}[0-9]{2})', 1), ''), nullif(regexp_extract(t, '([A-Z]{2,3}[ :/]{1}[0-9]{2}[ :/]{1}20[0-9]{2})', 1), '')) AS expiry_date FROM
    (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'BEST BEFORE ' || y || ' JA ' || dd WHEN 1 THEN y || 'JUN' || dd WHEN 2 THEN 'MR ' || dd || ' ' || y ELSE dd || '/' || mm || '/' || y END AS t
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%d') AS dd FROM orders))""")  # fmt: skip
def extract_expiry(s, d):
    y, m, dd, k = (*(F.date_format("o_orderdate", p) for p in ("yyyy", "MM", "dd")), F.col("o_orderkey") % 4)
    t = F.when(k == 0, F.concat(F.lit("BEST BEFORE "), y, F.lit(" JA "), dd)).when(k == 1, F.concat(y, F.lit("JUN"), dd)).when(k == 2, F.concat(F.lit("MR "), dd, F.lit(" "), y)).otherwise(F.concat(dd, F.lit("/"), m, F.lit("/"), y))
    return _table(s, d, "orders").select("o_orderkey", ft.extract_expiry(t).alias("expiry_date"))


def bars(orders: DataFrame) -> DataFrame:
    """Text annotations (file, pos, text, box) of a barcode for each order: the whole text, then parts from left to right."""
    left, right = (F.col("o_custkey") % 10).cast("string"), (F.col("o_orderkey") % 7).cast("string")
    a, b = (F.lpad((F.col(c) % 100000).cast("string"), 5, "0") for c in ("o_orderkey", "o_custkey"))
    whole = F.when(F.col("o_custkey") % 3 == 0, F.concat_ws(" ", left, a, b, right)).otherwise(F.concat(a, b))
    texts = F.array(whole, F.lit("Item"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(a, F.lit("-"), b)).otherwise(a), b, F.when(F.col("o_custkey") % 5 == 0, F.lit("x")).otherwise(left), right)
    places = [(0, 300), (0, 300), (100, 150), (160, 220), (20, 40), (250, 270)]
    box = F.element_at(F.array(*(F.struct(F.lit(x0).alias("x0"), F.lit(0).alias("y0"), F.lit(x1).alias("x1"), F.lit(50).alias("y1")) for x0, x1 in places)), F.col("pos") + 1)
    return orders.select(F.col("o_orderkey").alias("file"), F.posexplode(texts).alias("pos", "text")).withColumn("box", box)


@query("SELECT file, CASE WHEN length(dd) = 12 THEN dd END AS upc FROM (SELECT file, regexp_replace(text, '[^0-9]+', '', 'g') AS dd FROM bars WHERE pos = 0)", after=("bars",))
def upc_find_full(s, d):
    return bars(_table(s, d, "orders")).where("pos = 0").select("file", upc.full_code("text").alias("upc"))


@query(
    r"""SELECT file, arg_min(CASE WHEN length(dd) = 10 THEN dd ELSE dd || nx END, pos) AS middle FROM (SELECT *, lead(dd) OVER (PARTITION BY file ORDER BY pos) AS nx FROM
    (SELECT file, pos, regexp_replace(text, '[^0-9]+', '', 'g') AS dd FROM bars WHERE pos > 0)) WHERE (length(dd) = 10 AND nx IS NOT NULL) OR (length(dd) = 5 AND length(nx) = 5) GROUP BY file""", after=("bars",))  # fmt: skip
def upc_middle_pairs(s, d):
    return upc.middle(bars(_table(s, d, "orders"))).select("file", "middle")


@query(
    r"""SELECT file, CASE WHEN length(whole) = 12 THEN whole ELSE CASE WHEN l = 'x' THEN '?' ELSE l END || lpad(CAST(file % 100000 AS VARCHAR), 5, '0') || b || r END AS upc FROM (SELECT file, max(CASE WHEN pos = 0 THEN regexp_replace(text, '[^0-9]+', '', 'g') END) AS whole,
    max(CASE WHEN pos = 3 THEN text END) AS b, max(CASE WHEN pos = 4 THEN text END) AS l, max(CASE WHEN pos = 5 THEN text END) AS r FROM bars GROUP BY file)""", after=("bars",))  # fmt: skip
def upc_codes(s, d):
    return upc.codes(bars(_table(s, d, "orders")))


@query("SELECT a.o_orderkey AS file, CASE WHEN b1 < 100 THEN 'left' WHEN b0 > 160 THEN 'right' ELSE 'overlap' END AS direction FROM (SELECT o_orderkey, o_custkey % 300 AS b0, o_custkey % 300 + 20 AS b1 FROM orders) a")
def upc_direction(s, d):
    box = lambda x0, x1: F.struct(x0.alias("x0"), F.lit(0).alias("y0"), x1.alias("x1"), F.lit(50).alias("y1"))
    t = _table(s, d, "orders").select(F.col("o_orderkey").alias("file"), box(F.lit(100), F.lit(160)).alias("a"), box(F.col("o_custkey") % 300, F.col("o_custkey") % 300 + 20).alias("b"))
    return t.select("file", fb.direction(F.col("a"), F.col("b")).alias("direction"))


@query(
    """SELECT user_id, round(avg(value), 6) AS avg, round(var_pop(value), 6) AS var, min(value) AS min, max(value) AS max, round((s[CAST(floor((len(s) - 1) * 0.25) AS INT) + 1] + s[CAST(ceil((len(s) - 1) * 0.25) AS INT) + 1]) / 2, 6) AS p25,
    round((s[CAST(floor((len(s) - 1) * 0.75) AS INT) + 1] + s[CAST(ceil((len(s) - 1) * 0.75) AS INT) + 1]) / 2, 6) AS p75 FROM events JOIN (SELECT user_id, list(value ORDER BY value) AS s FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id, s""")  # fmt: skip
def curvature_stats(s, d):
    t = ln.curvature_stats(_table(s, d, "events"), "user_id", "value")
    return t.select("user_id", *(F.round(c, 6).alias(c) for c in ("avg", "var")), "min", "max", *(F.round(c, 6).alias(c) for c in ("p25", "p75")))


@query(
    """SELECT l_suppkey, n, round(mx, 4) AS mx, round(my, 2) AS my, round(0.5 * atan2(2 * sxy, sxx - syy), 6) AS theta FROM (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my,
    var_pop(l_quantity) AS sxx, var_pop(l_extendedprice / 1000) AS syy, covar_pop(l_quantity, l_extendedprice / 1000) AS sxy FROM lineitem GROUP BY l_suppkey)""")  # fmt: skip
def line_fit_tls(s, d):
    t = _table(s, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return ln.total_least_squares(t, "l_suppkey").select("l_suppkey", "n", F.round("mx", 4).alias("mx"), F.round("my", 2).alias("my"), F.round("theta", 6).alias("theta"))


_SEGMENT = "SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INT) AS line_id, CAST(l_partkey % 50 AS INT) AS x1, CAST(l_suppkey % 400 AS INT) AS y1, CAST(l_partkey % 50 + l_quantity * 10 AS INT) AS x2, CAST(l_suppkey % 400 + l_partkey % 7 AS INT) AS y2 FROM lineitem"


def _segments(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    p, y = F.col("l_partkey"), F.col("l_suppkey") % 400
    return _table(s, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.row_number().over(order) - 1).alias("line_id"), *(c.cast("int").alias(n) for n, c in (("x1", p % 50), ("y1", y), ("x2", p % 50 + F.col("l_quantity") * 10), ("y2", y + p % 7))))


@query(f"SELECT * FROM ({_SEGMENT}) WHERE abs(x2 - x1) > 10 * abs(y2 - y1)")
def filter_lines(s, d):
    return ln.filter_lines(_segments(s, d))


@query(f"SELECT image_id, line_id, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (x2 - x1) ** 2 + (y2 - y1) ** 2 DESC, line_id) AS r FROM ({_SEGMENT})) WHERE r = 1")
def argmax_line(s, d):
    return ln.longest(_segments(s, d))


_CROSS = 'x1 <= b."left" + b.width AND x2 >= b."left" AND b.top <= CASE WHEN x1 = x2 THEN (y1 + y2) / 2 ELSE y1 + (y2 - y1) * (b."left" - x1) / (x2 - x1) END AND b.top + b.height >= CASE WHEN x1 = x2 THEN (y1 + y2) / 2 ELSE y1 + (y2 - y1) * (b."left" + b.width - x1) / (x2 - x1) END'


@query(f"SELECT * FROM ({_SEGMENT}) a WHERE NOT EXISTS (SELECT 1 FROM lb b WHERE a.image_id = b.image_id AND {_CROSS})", after=("lb",))
def lines_clear_of_boxes(s, d):
    return ln.clear_of_boxes(_segments(s, d), _labels(s, d))


@query(
    f"""SELECT image_id, line_id, x1, y1, x2, y2 FROM (SELECT *, min(CAST(bad AS INT)) OVER (PARTITION BY image_id) = 1 AS every FROM (SELECT a.*, coalesce(avg(CAST(held AS DOUBLE)), 0) > 0.5 OR coalesce(bool_or(held AND contains(lower(b.text), 'ingredients')), false) AS bad
    FROM ({_SEGMENT}) a LEFT JOIN (SELECT * FROM lb) b ON a.image_id = b.image_id, LATERAL (SELECT coalesce(NOT (b.top < a.y1), false) AS held) GROUP BY a.image_id, a.line_id, a.x1, a.y1, a.x2, a.y2)) WHERE NOT bad OR every""", after=("lb",))  # fmt: skip
def majority_side_filter(s, d):
    return ln.by_ingredients(_segments(s, d), _labels(s, d))


@query("SELECT doc_id AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def new_files(s, d):
    return rd.new_files(_table(s, d, "documents").select(F.col("doc_id").alias("file")), _table(s, d, "labels").select(F.col("doc_id").alias("file")))


@query("SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', '') AS stub FROM pages")
def image_names(s, d):
    return _table(s, d, "pages").select("page_id", ft.image_name("url").alias("name"), ft.image_stub("url").alias("stub"))


# the derived lines don't overlap, so the greedy numbering is that of the tops
@query("SELECT image_id, seq, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY top) - 1 AS INT) AS line FROM lb", after=("lb",))
def greedy_lines(s, d):
    return labels.greedy_lines(_lines(s, d))


@query()
def longest_monotone(s, d):
    t = _table(s, d, "events").select("user_id", "event_id", "value")
    return cv.monotone(t, "user_id", "event_id", "value")


@query()
def fuzzy_bilingual_split(s, d):
    t = _table(s, d, "documents").select("doc_id", F.concat(F.lit("Ingredients: "), "text", F.lit(" Ingrédients: "), "lang").alias("ingr_string"))
    return ig.bilingual(t)


@query()
def kmeans_fragments(s, d):
    points = _table(s, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return cv.clusters(points, "l_orderkey", ["x", "y"])


@query()
def conic_fits(s, d):
    points = _table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("image_id"), (F.col("l_partkey") % 4).cast("int").alias("curve_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return cv.fitted(points)


@query("SELECT conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS pos, text FROM conversations")
def annotation_blocks(s, d):
    return an.blocks(_responses(s, d))


@query("SELECT conv_id AS file, CAST(p AS INT) AS pos, CAST(10 * turn AS INT) AS x0, CAST(5 * p AS INT) AS y0, CAST(10 * turn + length(text) AS INT) AS x1, CAST(5 * p + 4 AS INT) AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p FROM conversations)")
def annotation_boxes(s, d):
    return an.block_boxes(_responses(s, d))


@query("SELECT conv_id AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS pos, role AS text, CAST(10 * turn AS INT) AS x0 FROM conversations")
def annotation_words(s, d):
    return an.text_annotations(_responses(s, d)).select("file", "pos", "text", F.col("box.x0").alias("x0"))


def _responses(s: SparkSession, d: str) -> DataFrame:
    """Nested responses of the readers' schema: each conversation a page, each turn a block with one paragraph of words of symbols, and a text annotation."""
    t = _table(s, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("e"))
    listed = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    def box(e, i):
        left, top = 10 * e["turn"], 5 * i
        right, low = left + F.length(e["text"]), top + 4
        return F.struct(F.array(corner(right, low), corner(left, top), corner(right, top), corner(left, low)).alias("vertices"))

    symbols = lambda w: F.struct(F.transform(F.split(w, ""), lambda c: F.struct(c.alias("text"))).alias("symbols"))
    words = lambda e: F.struct(F.transform(F.split(e["text"], " "), symbols).alias("words"))
    blocks = F.transform("e", lambda e, i: F.struct(box(e, i).alias("bounding_box"), F.array(words(e)).alias("paragraphs")))
    flat = F.transform("e", lambda e, i: F.struct(e["role"].alias("description"), box(e, i).alias("bounding_poly")))
    return listed.select(F.col("conv_id").alias("file"), F.struct(F.array(F.struct(blocks.alias("blocks"))).alias("pages")).alias("full_text_annotation"), flat.alias("text_annotations"))


_PREPARED = "'Ingredients: ' || replace(text, ' the ', ' and ') || ' (x) • (also) [y] or more'"


@query(
    f"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract({_PREPARED}, '^([^.]*)', 1), ' \\([^)]*\\)', '', 'g'), ' \\[[^\\]]*\\]', '', 'g'),
    ' (and/or|and|or|&) ', ', ', 'g'), '(?i)ingredients:', '', 'g'), ' • ', ', ', 'g'), '[^A-Za-z,]+,', ',', 'g'), '["'']', ', ', 'g') AS prepared FROM benchmark""")  # fmt: skip
def ingredients_prepared(s, d):
    text = F.concat(F.lit("Ingredients: "), F.replace("text", F.lit(" the "), F.lit(" and ")), F.lit(" (x) • (also) [y] or more"))
    return _table(s, d, "benchmark").select("item_id", ft.preprocess_ingredients(text).alias("prepared"))


@query(
    """SELECT key, string_agg(coalesce(correction, token), '' ORDER BY pos) AS text_corrected, CAST(count(correction) AS INT) AS n_corrections FROM toks LEFT JOIN
    (SELECT word, arg_min(l, (dist, l)) AS correction FROM (SELECT t.word, l.word AS l, levenshtein(t.word, l.word) AS dist, min(levenshtein(t.word, l.word)) OVER (PARTITION BY t.word) AS best FROM
        (SELECT DISTINCT lower(token) AS word FROM toks WHERE length(token) >= 5 AND lower(token) NOT IN (SELECT word FROM lexicon)) t JOIN lexicon l ON abs(length(t.word) - length(l.word)) <= 2 AND levenshtein(t.word, l.word) <= 2)
        WHERE dist = best GROUP BY word HAVING count(*) = 1) c ON lower(token) = c.word GROUP BY key""", after=("toks", "lexicon"))  # fmt: skip
def text_corrected(s, d):
    t = _table(s, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.regexp_replace("text", "[^ -~]+", "").alias("text")).where("text <> ''")  # DuckDB's distance counts bytes
    return ig.correct(t, _ascii_words(_table(s, d, "benchmark")), "key", "text").select("key", "text_corrected", "n_corrections")


@query("SELECT image_id, seq, term FROM (SELECT image_id, seq, lower(text) AS w FROM mw), terms WHERE w = term", after=("mw", "terms"))
def exact_hits(s, d):
    joined = lambda w: w.map(lambda t: t.replace(" ", "_"))
    hits = labels.phrase_hits(_lines(s, d), [t.replace(" ", "_") for t in TERMS], 0, (*labels.MERGED, joined))
    return hits.select("image_id", "seq", F.replace("term", F.lit("_"), F.lit(" ")).alias("term"))


@query("SELECT image_id, nutrient, seq, CAST(p0 AS INT) AS \"at\" FROM la WHERE nutrient <> 'portion_size' AND p0 IS NOT NULL", after=("la",))
def right_most_name(s, d):
    return labels.nutrient_hits(_lines(s, d), named=True)


@query(f"SELECT image_id, {_RENUMBER.format('seq')}, text FROM lb WHERE (image_id, seq) NOT IN (SELECT image_id, seq FROM lb WHERE starts_with(lower(text), 'fat') OR ends_with(lower(text), 'fat'))", after=("lb",))
def rows_dropped(s, d):
    t = _labels(s, d)
    return bx.drop_rows(t, fz.edge_hits(t, ["fat"])).select("image_id", "seq", "text")


@query(
    """SELECT a.image_id, a.nutrient, CASE WHEN q THEN NULL WHEN a.quantity_status IS NULL THEN b.quantity ELSE a.quantity END AS quantity, CASE WHEN q THEN 'conflict' ELSE coalesce(a.quantity_status, b.quantity_status) END AS quantity_status,
    CASE WHEN a.unit <> b.unit THEN 'conflict' ELSE coalesce(a.unit, b.unit) END AS unit, CASE WHEN v THEN NULL WHEN a.dv_status IS NULL THEN b.dv ELSE a.dv END AS dv, CASE WHEN v THEN 'conflict' ELSE coalesce(a.dv_status, b.dv_status) END AS dv_status
    FROM fx a LEFT JOIN (SELECT * REPLACE (image_id + 1 AS image_id) FROM fx WHERE nutrient <> 'portion_size') b USING (image_id, nutrient),
    LATERAL (SELECT coalesce(a.quantity_status = 'ok' AND b.quantity_status = 'ok' AND a.quantity <> b.quantity, false) AS q, coalesce(a.dv_status = 'ok' AND b.dv_status = 'ok' AND a.dv <> b.dv, false) AS v)""", after=("fx",))  # fmt: skip
def merge_conflicts(s, d):
    found = written(labels.facts(_lines(s, d)))
    return fc.merge(found, found.withColumn("image_id", F.col("image_id") + 1), test_conflicts=True)


@query("SELECT image_id, max(CASE WHEN nutrient = 'fat' THEN quantity END) AS fat, max(CASE WHEN nutrient = 'sodium' THEN unit END) AS sodium_unit, max(CASE WHEN nutrient = 'iron' THEN dv END) AS iron_dv FROM fx GROUP BY image_id", after=("fx",))
def facts_wide(s, d):
    t = fc.wide(labels.facts(_lines(s, d)))
    return t.select("image_id", F.col("fat.quantity").alias("fat"), F.col("sodium.unit").alias("sodium_unit"), F.col("iron.dv").alias("iron_dv"))


@query("SELECT image_id, string_agg(nutrient, ',' ORDER BY nutrient) AS names, max(CASE WHEN nutrient = 'fat' THEN quantity END) AS fat FROM fx GROUP BY image_id", after=("fx",))
def facts_map(s, d):
    t = fc.as_map(labels.facts(_lines(s, d)))
    return t.select("image_id", F.array_join(F.map_keys("facts"), ",").alias("names"), F.col("facts")["fat"]["quantity"].alias("fat"))


@query("SELECT o_custkey AS file, arg_min('k' || o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS upc FROM orders GROUP BY o_custkey")
def upc_first_cutoff(s, d):
    code = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("k"), F.col("o_orderkey").cast("string")))
    return upc.first_cutoff(_table(s, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("cutoff_no"), code.alias("upc")))


@query(f"SELECT image_id, line_id, round(CASE WHEN x1 = x2 THEN (y1 + y2) / 2 ELSE y1 + (y2 - y1) * (100 - x1) / (x2 - x1) END, 6) AS y FROM ({_SEGMENT})")
def y_on_line(s, d):
    return _segments(s, d).select("image_id", "line_id", F.round(fb.y_at(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(100)), 6).alias("y"))


@query('SELECT image_id, seq, CAST(least("left" + width, 500) AS INT) AS x0, CAST(least(greatest(top - 10, 0), 200) AS INT) AS y0, CAST(least("left" + width + 150, 500) AS INT) AS x1, CAST(least(top + height + 10, 200) AS INT) AS y1 FROM lb', after=("lb",))
def crop_to_right(s, d):
    box = fb.right_crop(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.lit(500), F.lit(200))
    return _labels(s, d).select("image_id", "seq", box.alias("b")).select("image_id", "seq", "b.*")

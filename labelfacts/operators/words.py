"""The label steps over the words of many images at once, as numpy kernels: one shuffle by image serves the whole chain, and no step sorts or joins words again.

Texts are codes into a batch's vocabulary, so what is told by a word alone (clean-up, parts, nearness to a term) is found out once for each distinct one.
Within a batch the rows are sorted by image and seq.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..vocabulary import AMOUNT_ONLY, FOOTERS, FOREIGN, FRENCH, LINE_FUDGE, OVERLAP, SHORT, SMALL_HEIGHT, TERMS, UNITS
from .grouped import sizes

_MISREAD = (("é", "e"), ("*", ""), ("gt", "g"), ("gf", "g"), ("sugarstt", "sugars"), ("sugarst", "sugars"), ("sucrestt", "sucres"), ("sucrest", "sucres"), (" ", ""), ("(", ""), (")", ""))
_COMMA, _OH, _PARTS, _DIGITS, _LEADING = (re.compile(p, re.ASCII) for p in (r"^[0-9]+,[0-9]+", r"^[0-9]*[Oo](mg|g)", r"\d+\.*\d*|[^\d]+", r"[0-9]+", r"[0-9]+\.[0-9]+"))
_cached = lru_cache(1 << 16)


@_cached
def clean(t: str | None) -> str | None:
    """functions.text.clean."""
    if t is None:
        return None
    t = (t.replace(",", ".") if _COMMA.match(t) else t).lower()
    for wrong, right in _MISREAD:
        t = t.replace(wrong, right)
    return t


@_cached
def respelt(t: str | None) -> str | None:
    """functions.text.oh_to_zero and fix_spelling."""
    return None if t is None else ("0g" if _OH.match(t) else t).replace("fiber", "fibre").replace("satures", "sature")


@_cached
def parts(t: str | None) -> list[str | None]:
    """functions.text.parts."""
    for found in ([], []) if t is None else (_PARTS.findall(t), [p for p in t.split("/") if p]):
        if len(found) > 1:
            return found
    return [t]


@_cached
def number(t: str | None) -> float:
    """functions.text.number; NaN where there is none."""
    m = t is not None and (_DIGITS.fullmatch(t) or _LEADING.match(t))
    return float(m.group()) if m else np.nan


def within(a: str | None, b: str, most: int) -> bool:
    """functions.text.within."""
    if a is None or abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    if most == 1:
        i = 0
        while i < len(a) and i < len(b) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


@_cached
def same(word: str | None, term: str) -> bool:
    """operators.facts._same."""
    return within(word, term, 1) and ("vitamin" not in term or word[-1:] == term[-1])


@_cached
def is_vitamin(t: str | None) -> bool:
    return within(t, "vitamin", 1) or within(t, "vitamine", 1)


def names(nutrient: str) -> list[str]:
    return list(dict.fromkeys([nutrient, FRENCH.get(nutrient, nutrient), *SHORT.get(nutrient, [])]))


class Words:
    """Columns of a batch's words: image (number in the batch), row (of the batch, where the rest stands), code of the text, left and width."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        """Of rows that are words, or printed lines (image_id, line_no, text) as readers.label_boxes takes them."""
        self.table, self.starts, self.images = table, starts, len(starts)
        self.row, text = np.arange(len(table)), table["text"].combine_chunks()
        self.of_lines = "line_no" in table.column_names and "left" not in table.column_names
        if self.of_lines:
            split = pc.split_pattern(text, " ")
            text, self.row = split.flatten(), pc.list_parent_indices(split).to_numpy()
            some = pc.not_equal(text, "")
            text, self.row = text.filter(some), self.row[some.to_numpy(zero_copy_only=False)]
        self.image = np.repeat(np.arange(len(starts)), sizes(starts, len(table)))[self.row]
        text = text.dictionary_encode(null_encoding="encode")
        self.texts: list[str | None] = text.dictionary.to_pylist()
        self.codes = {t: i for i, t in enumerate(self.texts)}
        self.code = text.indices.to_numpy().astype(np.int64)
        if self.of_lines:
            length = np.array([len(t) for t in self.texts], np.int64)[self.code]
            begin = np.maximum.accumulate(np.where(np.diff(self.row, prepend=-1) > 0, np.arange(len(self.row)), 0))
            before = np.cumsum(length + 1) - length - 1
            self.left, self.width, self.height = 10 * (before - before[begin]), 10 * length, np.full(len(self.row), 20)
            self.top = 40 * table["line_no"].to_numpy().astype(np.int64)[self.row]
        else:
            self.left, self.width, self.top, self.height = (table[c].to_numpy().astype(np.int64) for c in ("left", "width", "top", "height"))

    def keep(self, mask: np.ndarray) -> None:
        for c in ("image", "row", "code", "left", "width", "top", "height"):
            setattr(self, c, getattr(self, c)[mask])

    @property
    def begin(self) -> np.ndarray:
        """Where each word's image begins."""
        n = len(self.image)
        return np.maximum.accumulate(np.where(np.diff(self.image, prepend=-1) > 0, np.arange(n), 0)) if n else np.empty(0, int)

    @property
    def seq(self) -> np.ndarray:
        return np.arange(len(self.image)) - self.begin

    def put(self, text: str | None) -> int:
        code = self.codes.setdefault(text, len(self.texts))
        if code == len(self.texts):
            self.texts.append(text)
        return code

    def each(self, f: Callable, kind=bool) -> np.ndarray:
        """f of each word's text."""
        return np.fromiter((f(t) for t in self.texts), kind, len(self.texts))[self.code]

    def map(self, f: Callable[[str | None], str | None]) -> None:
        self.code = np.array([self.put(f(t)) for t in self.texts[:]], np.int64)[self.code]

    def near(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-th word after each one is (before it, for n below 0), and whether it is in the same image."""
        to = np.arange(len(self.code)) + n
        at = np.clip(to, 0, max(len(to) - 1, 0))
        return at, (at == to) & (self.image[at] == self.image)

    def code_near(self, n: int) -> np.ndarray:
        """The code of the n-th word after each one; -1 beyond the image."""
        at, here = self.near(n)
        return np.where(here, self.code[at], -1)

    def text_of(self, codes: np.ndarray, f: Callable, kind=bool, beyond=False) -> np.ndarray:
        """f of the texts of codes; ``beyond`` for -1."""
        return np.append(np.fromiter((f(t) for t in self.texts), kind, len(self.texts)), kind(beyond))[codes]

    def column(self, at: np.ndarray, name: str) -> pa.ChunkedArray:
        return self.table[name].take(pa.array(self.row[at]))

    def text(self, codes: np.ndarray) -> pa.Array:
        return pa.array(self.texts, pa.string()).take(pa.array(codes, mask=codes < 0))

    def boxes(self) -> pa.Table:
        """All columns of the batch's table, with dense seq; of lines, those of boxes."""
        kinds = {"image_id": None, "seq": pa.int32(), "text": None} | dict.fromkeys(("left", "top", "width", "height"), pa.int32()) if self.of_lines else {f.name: f.type for f in self.table.schema}
        made = {"text": self.text(self.code)} | {c: pa.array(getattr(self, c)).cast(kinds[c]) for c in ("seq", "left", "top", "width", "height")}
        return pa.table({c: made[c] if c in made else self.column(slice(None), c) for c in kinds})


def first_only(hit: np.ndarray, group_begin: np.ndarray) -> np.ndarray:
    """Rows before their group's first hit."""
    n = np.append(0, np.cumsum(hit))
    return n[1:] - n[group_begin] == 0


def phrases(w: Words, terms: list[str], most: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where (positions, numbers of terms, texts) a run of as many words as a term has is at most ``most`` edits from it, in lower case."""
    at, which, found = [], [], []
    lower = [None if t is None else t.lower() for t in w.texts]
    plain = all(lower[c] and lower[c] == lower[c].strip(" ") for c in np.unique(w.code))
    length = np.array([len(t or "") for t in lower])[w.code] + 1
    memo: dict[tuple, str | None] = {}
    known = {x for t in lower if t is not None for x in t.split(" ")}
    intact = lambda t: t.count(" ") + 1 - 2 * most  # words of a term that are left whole at least: an edit spoils two at most
    terms_of = [t for t in terms if not plain or sum(x in known for x in t.split(" ")) >= intact(t)]
    for n in sorted({t.count(" ") + 1 for t in terms_of}):
        near = [w.near(k) for k in range(n)]
        long = sum(np.where(here, length[a], 0) for a, here in near) - 1
        last = np.max([np.where(here, a, 0) for a, here in near], axis=0)
        for i, t in enumerate(terms):
            if t.count(" ") + 1 != n or t not in terms_of:
                continue
            if n == 1:
                hit = w.text_of(w.code, lambda x: x is not None and within(x.lower().rstrip(" "), t, most))
            elif not plain:
                hit = np.ones(len(w.code), bool)
            else:
                hit = np.abs(long - len(t)) <= most
                if most <= 1 and len(t) >= 6:  # an edit leaves the three letters at one of the ends alone
                    start = np.fromiter((t.startswith((x or "") [:3]) and t.startswith(f"{x} "[:3]) if x is not None else False for x in lower), bool, len(lower))
                    end = np.fromiter((t.endswith(f" {x}"[-3:]) for x in lower), bool, len(lower))
                    hit &= start[w.code] | end[w.code[last]]
                elif intact(t) > 0:
                    has = np.array([sum(y in t.split(" ") for y in (x or "").split(" ")) for x in lower])[w.code]
                    hit &= sum(np.where(here, has[a], 0) for a, here in near) >= intact(t)
            rows = np.flatnonzero(hit)
            if n == 1:
                at.append(rows)
                which.append(np.full(len(rows), i))
                found += [lower[c].rstrip(" ") for c in w.code[rows]]
                continue
            codes = np.stack([np.where(here[rows], w.code[a[rows]], -1) for a, here in near], 1)
            good = []
            for key in map(tuple, codes.tolist()):
                k = (i, key)
                if k not in memo:
                    text = " ".join(lower[c] for c in key if c >= 0 and lower[c] is not None).rstrip(" ")
                    memo[k] = text if (Counter(text.split(" ")) & Counter(t.split(" "))).total() >= intact(t) and within(text, t, most) else None
                good.append(memo[k])
            ok = np.fromiter((g is not None for g in good), bool, len(good))
            at.append(rows[ok])
            which.append(np.full(ok.sum(), i))
            found += [g for g in good if g is not None]
    none = np.empty(0, int)
    return np.concatenate([none, *at]), np.concatenate([none, *which]), found


def clean_up(w: Words) -> None:
    """boxes.clean_up: misreadings, footers, "calories from", parts, blanks."""
    w.map(clean)
    hit = np.zeros(len(w.code), bool)
    hit[phrases(w, FOOTERS, 1)[0]] = True
    w.keep(first_only(hit, w.begin))
    calories = w.codes.get("calories", -1)
    if (w.code == calories).any():
        order = np.lexsort((w.top, w.image))
        image, top, code = w.image[order], w.top[order], w.code[order]
        new = (np.diff(image, prepend=-1) != 0) | (np.diff(top, prepend=top[:1]) != 0)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        follows = np.append((code[1:] == w.codes.get("from", -1)) & ~new[1:], False)
        mask = np.empty(len(new), bool)
        mask[order] = first_only((code == calories) & follows, begin)
        w.keep(mask)
    w.map(respelt)
    split_items(w)
    w.keep(w.each(lambda t: t is not None and t not in ("", " ")))


def split_items(w: Words) -> None:
    """boxes.split_items."""
    split = [parts(t) for t in w.texts]
    n = np.array([len(p) for p in split])
    if (n > 1).any():
        codes = np.array([w.put(x) for p in split for x in p])
        base = np.cumsum(n) - n
        count, code, length = n[w.code], w.code, np.array([len(t or "") for t in w.texts])
        w.keep(np.repeat(np.arange(len(code)), count))
        begin = np.repeat(np.cumsum(count) - count, count)
        part = np.arange(len(begin)) - begin
        whole = np.repeat(code, count)
        w.code = codes[base[whole] + part]
        share = np.floor(length[w.code] / np.maximum(length[whole], 1) * w.width).astype(np.int64)
        before = np.cumsum(share) - share
        w.left, w.width = w.left + before - before[begin], share


def merge_vitamins(w: Words) -> None:
    """boxes.merge_vitamins."""
    vitamin = w.each(is_vitamin)
    if not vitamin.any():
        return
    one, two = w.code_near(1), w.code_near(2)
    letter = w.text_of(one, lambda t: t is not None and len(t) <= 2 and t != "/" and not is_vitamin(t))
    six = (one == w.codes.get("b", -2)) & w.text_of(two, lambda t: t is not None and bool(_DIGITS.fullmatch(t)))
    take = np.where(vitamin & letter, np.where(six, 2, 1), 0)
    _join(w, take, [one, two])


def _join(w: Words, take: np.ndarray, after: list[np.ndarray]) -> None:
    """Each word with the ``take`` words after it becomes one item, with blanks."""
    made: dict[tuple, int] = {}
    code, width = w.code.copy(), w.width.copy()
    for k in range(1, len(after) + 1):
        rows = np.flatnonzero(take >= k)
        width[rows] += w.width[rows + k]
    for i in np.flatnonzero(take):
        key = (w.code[i], *(a[i] for a in after[: take[i]]))
        if key not in made:
            made[key] = w.put(" ".join(w.texts[c] for c in key))
        code[i] = made[key]
    gone = np.zeros(len(take), bool)
    for k in range(1, len(after) + 1):
        at, here = w.near(-k)
        gone |= here & (take[at] >= k)
    w.code, w.width = code, width
    w.keep(~gone)


def merge_vocabulary(w: Words, vocabulary: list[str]) -> None:
    """boxes.merge_vocabulary."""
    heads, tails = ({f(v, k) for v in vocabulary for k in range(len(v) + 1)} for f in (lambda v, k: v[:k], lambda v, k: v[k:]))
    one = w.code_near(1)
    pair = w.each(lambda t: t in heads) & w.text_of(one, lambda t: t in tails)
    rows, known = np.flatnonzero(pair), set(vocabulary)
    pair[rows] = [w.texts[a] + w.texts[b] in known for a, b in zip(w.code[rows], one[rows])]
    if not pair.any():
        return
    at = np.arange(len(pair))
    single = np.append(-1, np.maximum.accumulate(np.where(pair, -1, at))[:-1])
    _join(w, (pair & ((at - np.maximum(single, w.begin - 1)) % 2 == 1)).astype(int), [one])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, and where groups of equal ones begin in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _over(values: np.ndarray, f: np.ufunc, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """f over each row's group, for every row."""
    out = np.empty_like(values)
    if len(values):
        out[order] = np.repeat(f.reduceat(values[order], starts), sizes(starts, len(order)))
    return out


def nutrient_hits(w: Words, terms: list[str] = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """facts.nutrient_hits: positions and numbers of terms."""
    near = [[(i, k) for i, t in enumerate(terms) for k in [next((k for k, n in enumerate(names(t)) if x is not None and same(x.lower(), n)), None)] if k is not None] for x in w.texts]
    n = np.array([len(p) for p in near])
    flat = np.array([p for x in near for p in x], int).reshape(-1, 2)
    count, base = n[w.code], np.cumsum(n) - n
    at = np.repeat(np.arange(len(w.code)), count)
    pick = base[w.code[at]] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    term, level = flat[pick].T
    best = level == _over(level, np.minimum, *groups(w.image[at], term))
    return at[best], term[best]


def choose_hits(w: Words, at: np.ndarray, term: np.ndarray, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """facts.choose_hits."""
    g = groups(w.image[at], term)
    before, after = w.code_near(-1)[at], w.code_near(1)[at]
    top, is_ = w.top[at], lambda *n: np.isin(term, [i for i, t in enumerate(terms) if t in n])
    many = (_over(np.ones(len(at), int), np.add, *g) > 1) & (_over(top, np.minimum, *g) != _over(top, np.maximum, *g))
    first, end = at == _over(at, np.minimum, *g), _over((after < 0).astype(int), np.maximum, *g) == 1
    holds = lambda c, x: w.text_of(c, lambda t: t is not None and x in t)
    total = before == w.codes.get("total", -2)
    rank = np.select(
        [~many & first, ~many | (is_("sugars") & (end | (after == w.codes.get("alcohols", -2)))), is_("fat", "sugars", "carbohydrate") & total, is_("fat") & ~holds(before, "saturated"), is_("fat"), is_("sugars", "carbohydrate") | (is_("fibre") & (holds(before, "soluble") | holds(after, "soluble")))],
        [0, 9, 0, 1, 2, 1], 0)
    best = (rank < 9) & (rank == _over(rank, np.minimum, *g))
    return at[best], term[best]


def serving_hits(w: Words) -> np.ndarray:
    """facts.serving_hits: positions."""
    before, two = w.code_near(-1), w.code_near(-2)
    amount, per = w.codes.get("amount", -2), w.codes.get("per", -2)
    edge = w.each(lambda t: t is not None and t != "copper" and (t.startswith(("per", "pour", "par")) or t.endswith(("per", "pour", "par"))))
    serving = w.each(lambda t: within(t, "serving", 1) or within(t, "portion", 1))
    return np.flatnonzero((edge & (before != amount)) | (serving & (before != per) & (two != amount)))


def pairs(w: Words, seeds: np.ndarray, test: Callable, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of seeds and positions of words of their images that the test (of numbers and positions) lets through; about ``most`` pairs are held at once."""
    count, begin = np.bincount(w.image, minlength=w.images)[w.image[seeds]], w.begin[seeds]
    done, ks, js = 0, [], []
    total = np.append(0, np.cumsum(count))
    while done < len(seeds):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + most, "right")) - 1)
        n = count[done:upto]
        k = np.repeat(np.arange(done, upto), n)
        j = begin[k] + np.arange(len(k)) - (total[k] - total[done])
        ok = test(k, seeds[k], j)
        ks.append(k[ok])
        js.append(j[ok])
        done = upto
    none = np.empty(0, int)
    return np.concatenate([none, *ks]), np.concatenate([none, *js])


def listed_pairs(w: Words, test: Callable) -> tuple[np.ndarray, pa.Array]:
    """Positions of words, and "seq:distance" of each pair of theirs, by distance and seq."""
    i, j = pairs(w, np.arange(len(w.code)), lambda k, i, j: test(w, i, j))
    far = w.left[j] - w.left[i]
    order = np.lexsort((j, far, i))
    i, j, far = i[order], j[order], far[order]
    text = pc.binary_join_element_wise(pa.array(w.seq[j]).cast(pa.string()), pa.array(far).cast(pa.string()), ":")
    starts = np.flatnonzero(np.diff(i, prepend=-1) > 0)
    return i[starts], pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)), pa.int32()), text), " ")


class Items:
    """facts.line_items: for each seed, the codes of the words to the right on its line, one seed's after the other's."""

    def __init__(self, w: Words, seeds: np.ndarray, wide: np.ndarray):
        k, j = pairs(w, seeds, lambda k, i, j: (w.left[j] >= w.left[i]) & np.where(wide[k], overlapping(w, i, j), on_line(w, i, j)))
        order = np.lexsort((j, w.left[j] - w.left[seeds[k]], k))
        k = k[order]
        self.w, self.seed, self.code = w, k, w.code[j[order]]
        self.count = np.bincount(k, minlength=len(seeds))
        self.begin = np.cumsum(self.count) - self.count
        self.pos = np.arange(len(self.code)) - self.begin[self.seed]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The code at a position of each seed's words; -1 beyond them."""
        ok = (at >= 0) & (at < self.count)
        return np.append(self.code, -1)[np.where(ok, self.begin + at, len(self.code))]

    def extreme(self, hit: np.ndarray, f: np.ufunc, none: int) -> np.ndarray:
        """Least or greatest position of a hit of each seed."""
        out = np.full(len(self.count), none)
        f.at(out, self.seed[hit], self.pos[hit])
        return out


def wide(term: np.ndarray, terms: list[str]) -> np.ndarray:
    """Nutrients for which any overlap counts as a line."""
    return np.isin(term, [i for i, t in enumerate(terms) if t in ("saturated", "trans")])


def on_line(w: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    centre = w.top[i] + w.height[i] / 2
    return (centre > w.top[j] - LINE_FUDGE) & (centre < w.top[j] + np.where(w.height[j] <= SMALL_HEIGHT, w.height[i], w.height[j]) + LINE_FUDGE)


def overlapping(w: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    ti, hi, tj, hj = w.top[i], w.height[i], w.top[j], w.height[j]
    return ((ti + hi - tj > OVERLAP * hj) & (ti < tj + hj)) | ((tj + hj - ti > OVERLAP * hj) & (tj < ti + hi))


def term_at(items: Items, term: np.ndarray, terms: list[str]) -> np.ndarray:
    """facts.term_at; -1 where there is none."""
    w = items.w
    name, short = (np.zeros((len(terms), len(w.texts)), bool) for _ in range(2))
    for i, t in enumerate(terms):
        for k, x in enumerate(w.texts):
            name[i, k] = same(x, t) or same(x, FRENCH.get(t, t))
            short[i, k] = any(same(x, s) for s in SHORT.get(t, []))
    own = term[items.seed]
    at = items.extreme(name[own, items.code], np.maximum, -1)
    return np.where(at >= 0, at, items.extreme(short[own, items.code], np.maximum, -1))


def serving_at(items: Items) -> np.ndarray:
    """facts.serving_at; -1 where there is none."""
    w = items.w
    digits = np.fromiter((t is not None and bool(_DIGITS.match(t)) for t in w.texts), bool, len(w.texts))
    nxt = np.append(items.code, -1)[1:]
    nxt = np.where(np.append(items.seed, -1)[1:] == items.seed, nxt, -1)
    hit = (items.pos >= 1) & digits[items.code] & w.text_of(nxt, lambda t: t in ("g", "ml"))
    at = items.extreme(hit, np.minimum, np.iinfo(int).max)
    return np.where(at < np.iinfo(int).max, at - 1, -1)


SERVING = "portion_size"


def values(w: Words, terms: list[str], hits: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """plans.labels.values: image, nutrient (number of the term, len(terms) for a serving), quantity, unit (a code, -1 for none) and dv."""
    at, term = choose_hits(w, *(nutrient_hits(w, terms) if hits is None else hits), terms)
    serving = serving_hits(w)
    seed, nutrient = np.concatenate([at, serving]), np.concatenate([term, np.full(len(serving), len(terms))])
    items = Items(w, seed, wide(nutrient, terms))
    place = np.where(nutrient == len(terms), serving_at(items), term_at(items, np.minimum(nutrient, len(terms) - 1), terms))
    for text in ("kcal", "conflict", "absent", *UNITS):
        w.put(text)
    read = np.append(np.fromiter((number(t) for t in w.texts), float, len(w.texts)), np.nan)
    value_at = lambda p: read[items.get(p)]
    shift = np.where(~np.isnan(value_at(place + 1)), 1, np.where(~np.isnan(value_at(place + 2)), 2, 0))
    after = lambda n: np.where(shift > 0, items.get(place + shift + n), -1)
    value, one, two, percent = read[after(0)], after(1), after(2), w.codes.get("%", -2)
    unit = np.where(np.isin(one, [w.codes[u] for u in UNITS]), one, -1)
    only = np.isin(nutrient, [i for i, t in enumerate([*terms, SERVING]) if t in AMOUNT_ONLY])
    share = ~only & (unit < 0) & (one == percent)
    calories = np.isin(nutrient, [i for i, t in enumerate(terms) if t == "calories"])
    dv = np.select([only, share, unit >= 0, two == percent], [np.nan, value, read[two], read[one]], np.nan)
    out = {"image": w.image[seed], "nutrient": nutrient, "quantity": np.where(share, np.nan, value), "unit": np.where((shift > 0) & calories, w.codes["kcal"], unit), "dv": dv}
    return {k: v[place >= 0] for k, v in out.items()}


OK, CONFLICT, BLANK, ABSENT = range(4)
STATUS = pa.array(["ok", "conflict", "blank", "absent"])


def facts(w: Words, v: dict[str, np.ndarray], terms: list[str]) -> dict[str, np.ndarray]:
    """facts.facts: a row of each image and nutrient; a status is a number of STATUS, -1 for none."""
    order, starts = groups(v["image"], v["nutrient"])
    out = {k: v[k][order][starts] for k in ("image", "nutrient")}
    span = lambda x: [f.reduceat(x[order], starts) if len(starts) else x[:0] for f in (np.fmin, np.fmax)]
    for c in ("quantity", "dv"):
        low, high = span(v[c])
        out[c] = np.where(low == high, low, np.nan)
        out[f"{c}_status"] = np.where(np.isnan(low), -1, np.where(low == high, OK, CONFLICT))
    low, high = span(np.where(v["unit"] < 0, np.nan, v["unit"]))
    out["unit"] = np.where(np.isnan(low), -1, np.where(low == high, low, w.put("conflict"))).astype(int)
    out["dv_status"] = np.where(_only(out, terms), BLANK, out["dv_status"])
    return out


def _only(f: dict[str, np.ndarray], terms: list[str]) -> np.ndarray:
    return np.isin(f["nutrient"], [i for i, t in enumerate([*terms, SERVING]) if t in AMOUNT_ONLY])


def complete(f: dict[str, np.ndarray], terms: list[str]) -> dict[str, np.ndarray]:
    """facts.complete."""
    images = np.unique(f["image"])
    key = np.sort(np.unique(np.concatenate([(images[:, None] * (len(terms) + 1) + np.arange(len(terms))).ravel(), f["image"] * (len(terms) + 1) + f["nutrient"]])))
    at = np.searchsorted(key, f["image"] * (len(terms) + 1) + f["nutrient"])
    out = {"image": key // (len(terms) + 1), "nutrient": key % (len(terms) + 1)}
    for c in ("quantity", "quantity_status", "unit", "dv", "dv_status"):
        out[c] = np.full(len(key), np.nan if c in ("quantity", "dv") else -1)
        out[c][at] = f[c]
    return out


def mark_absent(w: Words, f: dict[str, np.ndarray], hits: tuple[np.ndarray, np.ndarray], phrase: np.ndarray, terms: list[str]) -> None:
    """facts.mark_absent."""
    n, far = len(terms) + 1, np.iinfo(int).max
    first, where = np.full(w.images * n, far), np.full(w.images, far)
    np.minimum.at(first, w.image[hits[0]] * n + hits[1], hits[0])
    np.minimum.at(where, w.image[phrase], phrase)
    own = first[f["image"] * n + f["nutrient"]]
    empty = (f["quantity_status"] < 0) & (f["unit"] < 0) & ((f["dv_status"] < 0) | (f["dv_status"] == BLANK))
    gone = empty & ((own == far) | (own > where[f["image"]]))
    f["quantity_status"] = np.where(gone, ABSENT, f["quantity_status"])
    f["unit"] = np.where(gone, w.put("absent"), f["unit"])
    f["dv_status"] = np.where(gone & ~_only(f, terms), ABSENT, f["dv_status"])


def mark_by_format(w: Words, f: dict[str, np.ndarray], phrase: np.ndarray, terms: list[str]) -> None:
    """facts.new_format and mark_by_format."""
    of = lambda *n: np.isin(f["nutrient"], [i for i, t in enumerate(terms) if t in n])
    fresh = np.isin(f["image"], np.concatenate([w.image[phrase], f["image"][of("potassium", "iron", "calcium") & (f["unit"] == w.put("mg"))]]))
    no_dv = np.where(fresh, of("carbohydrate"), of("sugars"))
    no_amount = ~fresh & of(*[n for n in TERMS if n.startswith("vitamin") or n in ("iron", "calcium", "phosphorus", "magnesium", "zinc", "potassium")])
    for c, none in (("dv", no_dv), ("quantity", no_amount)):
        f[c], f[f"{c}_status"] = np.where(none, np.nan, f[c]), np.where(none, ABSENT, f[f"{c}_status"])
    f["unit"] = np.where(no_amount, w.put("absent"), f["unit"])


def foreign(w: Words, least: int = 3) -> np.ndarray:
    """facts.foreign_labels: numbers of the images."""
    hits = np.flatnonzero(w.each(lambda t: t in FOREIGN))
    order, starts = groups(w.image[hits], w.code[hits])
    first = np.sort(hits[order][starts])
    low, high = np.searchsorted(w.image[hits], w.image[first]), np.searchsorted(w.image[hits], w.image[first], "right")
    k = np.repeat(np.arange(len(first)), high - low)
    i, j = first[k], hits[np.repeat(low, high - low) + np.arange(len(k)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
    i = np.unique(i[(w.code[i] != w.code[j]) & on_line(w, i, j)])
    image, n = np.unique(w.image[i], return_counts=True)
    return image[n >= least]

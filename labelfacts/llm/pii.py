"""Operator 10: personal identifiers behind disguises, with offsets into the source.

A transducer turns a text into a normalised one and keeps, for every normalised character, the span of source characters it came from:
  1. homoglyphs, full-width forms and other scripts' digits become ASCII, invisible characters and soft hyphens vanish;
  2. "(at)", "[dot]", " at " and " dot " in their written forms in four languages become "@" and ".";
  3. runs of at least MIN_SPELLED spelled digits ("five five five ...", "double seven") become digits.
Identifiers (e-mail, phone, card number with Luhn's check, IPv4, IBAN with its check, US social security number, access keys) are found in the
normalised text, and each hit's span is mapped back. The bare words at and dot only count where a whole address results.

Rows: a null or empty text has no identifiers. Repeated rows give repeated hits. Where two hits overlap the earlier wins, then the longer, then
the kind in the order above. Further columns aren't read; a null doc_id is passed on; an empty table gives no rows. Offsets count Unicode characters of the source. Whole texts are searched; a long text is handled like a short one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_SPELLED = 6

_LOOK = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ѡ": "w", "ɡ": "g", "ι": "i", "ο": "o", "ν": "v", "ρ": "p", "α": "a", "κ": "k", "τ": "t", "υ": "u",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Removed altogether.
_GONE = "­​‌‍⁠﻿‎‏"


class _Homoglyphs(dict):
    """str.translate's table, filled as characters are met."""

    def __missing__(self, code: int) -> str | int:
        char = chr(code)
        made: str | int = code
        if char in _LOOK:
            made = _LOOK[char]
        elif char in _GONE:
            made = ""
        elif code > 0x2FF:
            try:
                made = str(unicodedata.decimal(char))
            except ValueError:
                flat = unicodedata.normalize("NFKC", char)
                if len(flat) == 1 and flat.isascii():
                    made = flat
        self[code] = made
        return made


_TABLE = _Homoglyphs()
#: Latin-1 and Latin Extended texts hold nothing that step 1 changes, but for these two.
_STRANGE = re.compile("[ ­ɑ-\U0010ffff]")
_DIGITS = {w: str(d) for d, words in enumerate((
    "zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf",
)) for w in words.split()}
_D = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_TIMES = {"double": 2, "triple": 3}
#: Words that most runs hold; a text without three of them near to each other has no run.
_SPELLED = re.compile(rf"\b(?:(?:double|triple)[ \t]+)?{_D}(?:(?:[ \t]*[-,.][ \t]*|[ \t]+)(?:(?:double|triple)[ \t]+)?(?:{_D}\b|\d\b)){{{MIN_SPELLED - 1},}}", re.I)
_SPELLED_WORD = re.compile(rf"(double|triple)?[ \t]*\b({_D}|\d)\b", re.I)
_AT, _DOT = r"at|arroba|arobase", r"dot|punkt|point|punto"
_BRACKETED = re.compile(rf"[ \t]*[\[({{<][ \t]*({_AT}|{_DOT}|@|\.)[ \t]*[\])}}>][ \t]*", re.I)
_ENDINGS = "com|org|net|edu|gov|io|info|biz|co|de|fr|es|uk|eu|example|test"
_HOST = rf"[\w-]{{1,63}}(?:(?:[ \t]+(?:{_DOT})[ \t]+|[ \t]*\.[ \t]*)[\w-]{{1,63}})*"
#: Any ending after a dot that is disguised as well, but for hosts like "the"; a plain dot after a bare "at" takes a common one, after "@" any.
_NO_HOST = r"(?!(?:the|a|an|this|that|each|every|one|der|die|das|dem|den|ein|einem|el|la|los|las|un|una|le|les|une)[ \t])"
_BARE = re.compile(rf"(?<![\w.])[\w.+-]{{1,64}}(?:[ \t]+(?:{_DOT})[ \t]+[\w+-]{{1,64}}){{0,3}}(?:[ \t]+(?:{_AT})[ \t]+{_NO_HOST}{_HOST}(?:[ \t]+(?:{_DOT})[ \t]+[a-z]{{2,24}}|(?:[ \t]+\.[ \t]+|\.)(?:{_ENDINGS}))|[ \t]*@[ \t]*{_HOST}(?:[ \t]+(?:{_DOT})[ \t]+[a-z]{{2,24}}|\.[a-z]{{2,24}}|[ \t]+\.[ \t]+(?:{_ENDINGS})))\b", re.I)
#: Part of whatever _BARE matches: without it there is none.
_BARE_HINT = re.compile(rf"@|[ \t](?:{_AT})[ \t]+[\w-]{{1,63}}(?:[ \t]*\.|[ \t]+(?:{_DOT})[ \t])", re.I)
_PART = re.compile(rf"[ \t]+({_AT})[ \t]+|[ \t]*(@)[ \t]*|[ \t]+({_DOT})[ \t]+|[ \t]*(\.)[ \t]*(?=[\w-])", re.I)

EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
_FIND = [
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-]){EMAIL}(?![A-Za-z0-9-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:(?:\+|00(?=[1-9]))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]?\d{4}|\d{10,11})(?![\w-]|\.\d)")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")),
    ("ip", re.compile(r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ssn", re.compile(r"(?<![\w.-])(?!000|666|9\d\d)\d{3}([ -])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-]|\.\d)")),
    ("key", re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})(?!\w)")),
]
_RANK = {k: i for i, (k, _) in enumerate(_FIND)}
#: A phone, card, IP or social security number or an IBAN holds a digit, an e-mail an @, a key its prefix: texts with none need no search.
_HINT = re.compile(r"[0-9@]|sk-|gh[pousr]_|AKIA")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Transduced:
    """A normalised text as runs: between runs characters map one to one, inside a run every character maps to the run's source span."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.runs: list[tuple[int, int, int, int]] = []  # normalised from, to, source from, to

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text, in order and apart from each other; earlier runs are carried through."""
        if not edits:
            return
        out, runs, last, shift = [], [], 0, 0
        for a, b, new in edits:
            out += [self.text[last:a], new]
            x, y = self.source(a, b)
            runs.append((a + shift, a + shift + len(new), x, y))
            shift += len(new) - (b - a)
            last = b
        out.append(self.text[last:])
        starts = [e[0] for e in edits]
        moved = np.cumsum([0] + [len(n) - (b - a) for a, b, n in edits])
        for p, q, x, y in self.runs:
            k = bisect_right(starts, p)
            if k and p < edits[k - 1][1] or k < len(edits) and edits[k][0] < q:
                continue  # swallowed by an edit
            runs.append((p + moved[k], q + moved[k], x, y))
        self.text, self.runs = "".join(out), sorted(runs)
        self._index()

    def _index(self) -> None:
        self._from = [r[0] for r in self.runs]

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the normalised span a..b."""
        if not self.runs:
            return a, b
        return self._point(a, False), self._point(b, True)

    def _point(self, at: int, end: bool) -> int:
        k = bisect_right(self._from, at - 1 if end else at) - 1
        if k < 0:
            return at
        p, q, x, y = self.runs[k]
        if at < q or end and at <= q and at > p:
            return y if end and at > p else x
        return y + at - q


def normalise(text: str) -> Transduced:
    t = Transduced(text)
    if _STRANGE.search(text):
        flat = text.translate(_TABLE)
        if len(flat) != len(text):  # some characters vanish: those are runs
            t.apply([(m.start(), m.end(), "") for m in re.finditer(f"[{_GONE}]+", text)])
            t.text = t.text.translate(_TABLE)
        else:
            t.text = flat
    low = t.text
    edits = [(m.start(), m.end(), "@" if re.fullmatch(_AT + "|@", m[1], re.I) else ".") for m in _BRACKETED.finditer(low)] if any(c in low for c in "[({<") else []
    t.apply(edits)
    if _BARE_HINT.search(t.text):
        edits = []
        for m in _BARE.finditer(t.text):
            edits += [(m.start() + p.start(), m.start() + p.end(), "@" if p[1] or p[2] else ".") for p in _PART.finditer(m[0]) if p[0] not in ("@", ".")]
        t.apply(edits)
    if _spelled_hint(t.text):
        t.apply([(m.start(), m.end(), "".join((_DIGITS.get(w[2].lower()) or w[2]) * _TIMES.get((w[1] or "").lower(), 1) for w in _SPELLED_WORD.finditer(m[0]))) for m in _SPELLED.finditer(t.text)])
    return t


_COMMON = re.compile(r"\b(?:two|three|four|five|seven|eight|nine|zwei|drei|vier|fünf|sieben|acht|neun|dos|tres|cuatro|cinco|siete|ocho|nueve|deux|trois|quatre|cinq|sept|huit|neuf|zero|null|cero|zéro|six|sechs|seis|one|eins|uno)\b", re.I)


def _spelled_hint(text: str) -> bool:
    for n, _ in enumerate(_COMMON.finditer(text)):
        if n == 1:
            return True
    return False


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of the identifiers of one text, in order."""
    t = normalise(text)
    flat, hits = t.text, []
    if not _HINT.search(flat):
        return []
    for kind, pattern in _FIND:
        if kind == "email" and "@" not in flat:
            continue
        for m in pattern.finditer(flat):
            digits = re.sub(r"\D", "", m[0])
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "iban" and not iban(m[0]) or kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            value = m[0].lower() if kind == "email" else m[0] if kind in ("ip", "key") else re.sub(r"[ .()-]", "", m[0])
            hits.append((m.start(), -m.end(), _RANK[kind], kind, value))
    for p, q, _, _ in t.runs:  # a number that was spelled out
        if 7 <= q - p <= 15 and flat[p:q].isdigit():
            hits.append((p, -q, _RANK["phone"], "phone", flat[p:q]))
    out, last = [], -1
    for a, b, _, kind, value in sorted(hits):
        if a >= last:
            last = -b
            out.append((kind, *t.source(a, -b), value))
    return out


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value, source) of every identifier: source is text[start:end], value its normalised form."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], *T._parse_datatype_string("kind string, start int, end int, value string, source string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                rows, hits, source = [], [], []
                for i, text in enumerate(b.column(1).slice(s, 512).to_pylist()):
                    for h in find(text) if text else ():
                        rows.append(s + i)
                        hits.append(h)
                        source.append(text[h[1] : h[2]])
                if rows:
                    kind, start, end, value = zip(*hits)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value), pa.array(source)], names=schema.names)

    return own.mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(spark.read.parquet(f"{sf_dir}/documents.parquet"))

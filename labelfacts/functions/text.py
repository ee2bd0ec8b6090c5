"""Text clean-up as Column expressions: all stay in the JVM. A null in gives a null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
NUMBER_PARTS = r"(\d+\.*\d*|[^\d]+)"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def french_floats(text: ColumnOrName) -> Column:
    """Every comma becomes a point in a text that starts with digits, a comma and digits."""
    t = _c(text)
    return F.when(t.rlike("^[0-9]+,[0-9]+"), F.translate(t, ",", ".")).otherwise(t)


def oh_to_zero(text: ColumnOrName) -> Column:
    """A misread zero before a unit: the whole word becomes 0g."""
    t = _c(text)
    return F.when(t.rlike("^[0-9]*[Oo](mg|g)"), F.lit("0g")).otherwise(t)


def fix_misreadings(text: ColumnOrName) -> Column:
    """Literal misreadings of a recogniser, in an order that matters."""
    t = _c(text)
    for wrong, right in (("é", "e"), ("*", ""), ("gt", "g"), ("gf", "g"), ("sugarstt", "sugars"), ("sugarst", "sugars"), ("sucrestt", "sucres"), ("sucrest", "sucres"), (" ", ""), ("(", ""), (")", "")):
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


def fix_spelling(text: ColumnOrName) -> Column:
    return F.replace(F.replace(_c(text), F.lit("fiber"), F.lit("fibre")), F.lit("satures"), F.lit("sature"))


def clean(text: ColumnOrName) -> Column:
    """Decimal commas, lower case, misreadings: what can be done word by word before footers are cut."""
    return fix_misreadings(F.lower(french_floats(text)))


def parts(text: ColumnOrName) -> Column:
    """Array of the numbers and other runs of a word; a word without a number is parted at its slashes, which vanish."""
    t = _c(text)
    by_number = F.filter(F.regexp_extract_all(t, F.lit(NUMBER_PARTS), 1), lambda p: p != "")
    by_slash = F.filter(F.split(t, "/"), lambda p: p != "")
    return F.when(F.size(by_number) > 1, by_number).when(F.size(by_slash) > 1, by_slash).otherwise(F.array(t))


def process_str(text: ColumnOrName) -> Column:
    """Only letters, some accented ones and spaces, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(_c(text), "[^A-Za-z éèêâ]+", "")))


def split_to_words(text: ColumnOrName) -> Column:
    """Array of the words of an ingredient list: blanks and , . ; : part words, what else isn't a letter vanishes."""
    letters = F.regexp_replace(F.translate(_c(text), ",.;:", "    "), "[^A-Za-z éèêâ]+", "")
    return F.filter(F.split(F.lower(letters), " "), lambda w: w != "")


def preprocess_ingredients(text: ColumnOrName) -> Column:
    """An ingredient statement as words with commas between; null becomes an empty text."""
    t = F.regexp_extract(_c(text), r"^([^.]*)", 1)
    for pattern, put in ((r" \([^)]*\)", ""), (r" \[[^\]]*\]", ""), (r" (and/or|and|or|&) ", ", "), ("(?i)ingredients:", ""), (" • ", ", "), ("[^A-Za-z,]+,", ","), ("[\"']", ", ")):
        t = F.regexp_replace(t, pattern, put)
    return F.coalesce(t, F.lit(""))


def extract_expiry(text: ColumnOrName) -> Column:
    """A date as a label prints it: year, month letters, day; or month letters, day, year; else null."""
    t = _c(text)
    first = F.nullif(F.regexp_extract(t, r"(20[0-9]{2}[ :/]{0,1}[A-Z]{2,3}[ :/]{0,1}[0-9]{2})", 1), F.lit(""))
    return F.coalesce(first, F.nullif(F.regexp_extract(t, r"([A-Z]{2,3}[ :/]{1}[0-9]{2}[ :/]{1}20[0-9]{2})", 1), F.lit("")))


def digits(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), "[^0-9]+", "")


def starts_or_ends(text: ColumnOrName, term: ColumnOrName) -> Column:
    return _c(text).startswith(_c(term)) | _c(text).endswith(_c(term))


def within(a: ColumnOrName, b: ColumnOrName, most: int) -> Column:
    """Whether two texts are at most so many edits apart; the length test spares most distances."""
    return (F.abs(F.length(_c(a)) - F.length(_c(b))) <= most) & F.levenshtein(_c(a), _c(b), most).between(0, most)


def number(text: ColumnOrName) -> Column:
    """The value of a whole or decimal number at the start of a word, else null."""
    t = _c(text)
    whole = F.when(t.rlike(r"^[0-9]+$"), t)
    return F.coalesce(whole, F.nullif(F.regexp_extract(t, r"^([0-9]+\.[0-9]+)", 1), F.lit(""))).cast("double")


def image_name(path: ColumnOrName) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)$", 1)


def image_stub(path: ColumnOrName) -> Column:
    return F.regexp_replace(image_name(path), r"\.[^.]*$", "")

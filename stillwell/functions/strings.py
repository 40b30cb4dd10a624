"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented letters and the plain letters they fold to, position by position.
ACCENTED = "ÀÁÂÃÄÅàáâãäåĀāÈÉÊËèéêëĒēÌÍÎÏìíîïĪīÒÓÔÕÖòóôõöŌōÙÚÛÜùúûüŪūÇçÑñŚśṢṣṬṭḌḍṆṇḤḥṚṛḶḷṀṁÝýÿ"
PLAIN = "AAAAAAaaaaaaAaEEEEeeeeEeIIIIiiiiIiOOOOOoooooOoUUUUuuuuUuCcNnSsSsTtDdNnHhRrLlMmYyy"

# Fixed value: what counts as a Latin-script place name.
LATIN_NAME = r"^[A-Za-z][A-Za-z .'\-()]{1,40}$"
MAX_OTHER_NAMES = 8


def fold(text: Column) -> Column:
    """Lower case, accents removed, every run of other characters one space."""
    plain = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def tidy_category(text: Column) -> Column:
    """Trimmed lower case; null, empty and ``-`` become ``unknown``."""
    t = F.lower(F.trim(F.coalesce(text, F.lit("unknown"))))
    return F.when(t.isin("-", ""), "unknown").otherwise(t)


def blank_to_null(text: Column, tokens: list[str]) -> Column:
    return F.when(~F.trim(text).isin(tokens), text)


def other_names(name: Column, ascii_name: Column, listed: Column) -> Column:
    """Alternative Latin-script spellings of a place: no repeats, clean spellings first, at most eight.

    ``listed`` is a comma-separated string. A clean spelling starts with a capital and has no apostrophe;
    shorter ones lead, and equal ones keep the order they were listed in.
    """
    words = F.transform(F.concat(F.array(ascii_name), F.split(F.coalesce(listed, F.lit("")), ",")), F.trim)
    words = F.filter(words, lambda a: a.rlike(LATIN_NAME) & (F.lower(a) != F.lower(name)))
    lowered = F.transform(words, F.lower)
    first_seen = F.filter(
        F.transform(words, lambda a, i: F.struct(
            (~F.substring(a, 1, 1).rlike("[A-Z]")).alias("small"), F.contains(a, F.lit("'")).alias("quoted"),
            F.length(a).alias("size"), i.alias("place"), a.alias("text"))),
        lambda s: F.array_position(lowered, F.lower(s["text"])) == s["place"] + 1)
    return F.slice(F.transform(F.array_sort(first_seen), lambda s: s["text"]), 1, MAX_OTHER_NAMES)

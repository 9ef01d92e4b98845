"""Expressions that Spark and SQL engines read alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words(text: str | Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    """Size of words(), without looking at each of them."""
    plain = F.btrim(col(text), F.lit(" \t\n\v\f\r"))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"\s+")))


def few_words(text: str | Column, most: int) -> Column:
    """Whether there are one to `most` words; the rest of a longer text isn't looked at."""
    return col(text).rlike(rf"^\s*+\S++(?:\s++\S++){{0,{most - 1}}}+\s*+\z")


def squeezed(text: str | Column) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def stripped(text: str | Column) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def first_match(text: str | Column, pattern: str, group: int = 0) -> Column:
    """Null where nothing matches."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole > 0, half_up(100.0 * part / whole)).otherwise(F.lit(0).cast("long"))


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def sql_string(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(conditions) -> Column:
    """How many hold."""
    return reduce(lambda a, b: a + b, (c.cast("long") for c in conditions))


def one_of(terms) -> str:
    """A pattern of any of the terms, branching letter by letter, so that few are tried at a place; of two that begin alike the longer first."""
    tree: dict = {}
    for t in terms:
        at = tree
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def made(node: dict) -> str:
        parts = [(c if c.isalnum() or c in " _" else f"\\{c}") + made(below) for c, below in sorted(node.items()) if c]
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
        return (body if len(parts) > 1 or not body else f"(?:{body})") + "?" if "" in node and body else body

    return made(tree)

"""Scores of documents from their features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careerlake.functions import dims


def content_score(bullets: Column, quantified: Column, strong: Column, variance: Column, spelling: Column, repeats: Column) -> Column:
    """40 for the share with numbers, 30 for strong verbs, 10 each for even lengths, spelling and variety; 0 without bullets."""
    n = F.greatest(bullets, F.lit(1))
    made = 40 * quantified + 30 * (strong / n) + (10 - 10 * F.least(variance / 50, F.lit(1.0))) + (10 - F.least(3 * spelling, F.lit(10))) + (10 - F.least(3 * repeats, F.lit(10)))
    return F.when(F.coalesce(bullets, F.lit(0)) == 0, 0.0).otherwise(F.round(made, 1))


def tailoring_score(hard: Column, soft: Column, title: Column) -> Column:
    """100 where there is nothing to tailor to."""
    return F.when(hard.isNull(), 100.0).otherwise(F.round(70 * hard + 20 * soft + F.when(title, 10.0).otherwise(0.0), 1))


def bias_score(findings: Column) -> Column:
    return 100.0 - F.least(8 * findings, F.lit(40))


def red_flags_score(format_score: Column | None, band: Column, overlaps: Column, unsupported: Column) -> Column:
    start = (100 + format_score) / 2 if format_score is not None else F.lit(100.0)
    length = F.when(band.isin("too_short", "too_long"), 15).when(band == "long_but_acceptable", 5).otherwise(0)
    return F.round(F.greatest(F.lit(0.0), start - length - F.least(10 * overlaps, F.lit(30)) - F.least(5 * unsupported, F.lit(20))), 1)


def seniority_score(regression: Column) -> Column:
    return F.when(regression, 80.0).otherwise(100.0)


def completeness(found: dict[str, Column], sections: Column) -> Column:
    """Weighted share of the fields that are there, and of the sections known."""
    parts = [F.when(c, w).otherwise(0.0) for name, c in found.items() if (w := dims.FIELD_WEIGHTS[name])]
    return F.round(100 * (sum(parts, F.lit(0.0)) + dims.FIELD_WEIGHTS["sections"] * sections), 1)


def composite(scores: dict[str, Column]) -> Column:
    """Each share is rounded before they are added."""
    return F.round(sum((F.round(c * dims.CATEGORY_WEIGHTS[name], 1) for name, c in scores.items()), F.lit(0.0)), 1)

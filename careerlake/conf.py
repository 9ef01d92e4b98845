"""Thresholds; every operator reads them from here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Conf:
    as_of: str = "2026-01-15"
    compat: bool = True
    gap_months: int = 3
    repeated_at: int = 4
    too_short: int = 150
    ideal: int = 700
    acceptable: int = 1100
    long_url: int = 80
    long_tenure: int = 15
    old_graduation: int = 20
    fuzzy_at: int = 85
    title_overlap: float = 0.5
    column_gap: float = 40.0
    column_share: float = 0.15
    same_line: float = 3.0


DEFAULT = Conf()

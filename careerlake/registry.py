"""The queries of the library and their SQL; each module of plans gives its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from careerlake.plans import boards, documents, flows, reports, resumes, store

MODULES = (documents, store, resumes, reports, flows, boards)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}
FLAGSHIP = "composite_score"

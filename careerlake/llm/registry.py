"""The queries of this package and their SQL."""

from __future__ import annotations

from careerlake.llm import bpe, classifier, divergence, filters, licenses, media, mixing, rules, secrets, simhash, sketches, templates, token_counts

MODULES = (bpe, classifier, divergence, filters, licenses, media, mixing, rules, secrets, simhash, sketches, templates, token_counts)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}

"""Stages and queries as registered."""

import hashlib
import re

import numpy as np
import pytest
from test_corpus import plain_components, plain_fingerprint, plain_raking
from test_texts import BASE, plain_em, plain_stats, tik  # noqa: F401

import __spark_entry__
import corpus_pipeline
from careerlake.llm import mixing, registry, secrets

MORE = {
    "hosting": (r"gh[opsur]_([A-Za-z0-9]+)", 30),
    "chat": (r"xox[abprs]-([A-Za-z0-9-]+)", 10),
    "maps": (r"AIza([A-Za-z0-9_-]+)", 30),
    "payment": (r"sk_(?:live|test)_([A-Za-z0-9]+)", 16),
    "signed": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 10),
    "private": (r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY----(-+)", 1),
}


def plain_votes(t):
    """Votes of the rules, in order: for, against, or None."""
    n_words, chars, symbols, twins, again = plain_stats(t)
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, n_lines = max(n_words, 1), max(len(lines), 1)
    local = sum(len(set(words[i : i + 50])) for i in range(0, len(words), 50)) / n
    letters, visible = len(re.findall("[A-Za-z]", t)), len(re.findall("[!-~]", t))
    loud, marks, latin = len(re.findall("[A-Z]", t)) / max(letters, 1), len(re.findall("[!?]", t)) / n, 2 * visible > chars
    share = letters / max(visible, 1)
    pairs = [
        (n >= 50, n < 20),
        (4 <= chars / n <= 6.5, chars / n < 3.5 or chars / n > 7.2),
        (symbols / n < 0.02, symbols / n > 0.1),
        (again / n < 0.05, again / n > 0.15),
        (twins / n_lines < 0.05 and len(lines) > 2, twins / n_lines > 0.3 and len(lines) > 3),
        (n >= 30 and local > 0.8, n >= 30 and local < 0.6),
        (loud < 0.06, loud > 0.3 and n >= 5),
        (marks < 0.05, marks > 0.2),
        (latin and share > 0.93, latin and share < 0.9),
    ]
    return [True if good else False if bad else None for good, bad in pairs], n_words < 20 or 100 * again > 30 * n_words


def plain_rules(docs):
    judged = [(d, *plain_votes(d["text"] or "")) for d in docs]
    share, good, bad = plain_em([v for _, v, failed in judged if not failed], 60)
    out = []
    for d, votes, failed in judged:
        g, b = share, 1 - share
        for x, p, q in zip(votes, good, bad):
            if x is not None:
                g, b = g * (1 - p if x else p), b * (1 - q if x else q)
        if not failed and g >= b:
            out.append(d)
    return out


def plain_first(docs):
    roots = plain_components([plain_fingerprint(d["text"] or "") for d in docs], [d["doc_id"] for d in docs])
    return [d for d, r in zip(docs, roots) if d["doc_id"] == r]


def plain_redacted(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, (p, g, n)) in enumerate(BASE.items()) for m in re.finditer(p, text) if len(m[g]) >= n]
    found += [(m.start(), 3 + i, m.end(), kind) for i, (kind, (p, n)) in enumerate(MORE.items()) for m in re.finditer(p, text) if len(m[1]) >= n]
    out, at = "", 0
    for s, _, e, kind in sorted(found):
        if s >= at:
            out += text[at:s] + f"[{kind}]"
        at = max(at, e)
    return out + text[at:]


def plain_mixture(docs):
    def cell(d):
        t = d["text"] or ""
        return d["source"] or "", d["lang"] or "", next((k for k, p in mixing.TOPICS.items() if re.search(p, t)), mixing.OTHER)

    cells = {}
    for d in docs:
        cells[cell(d)] = cells.get(cell(d), 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    w, _ = plain_raking({c: float(n) for c, n in cells.items()}, {}, mixing.ROUNDS)
    p = {c: w[c] / n if n else mixing.FRACTION for c, n in cells.items()}
    return [d for d in docs if int(hashlib.md5(f"{d['doc_id']}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32 < p[cell(d)]]


def test_pipeline_is_brute_force(spark, sf, tik):  # noqa: F811
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = plain_first(plain_rules(docs))
    for d in kept:
        d["text"] = plain_redacted(d["text"] or "")
    want = {}
    for d in plain_mixture(kept):
        ids = tik.encode_ordinary(d["text"])
        want[d["doc_id"]] = (np.array(ids, "<u4").tobytes(), len(ids), hashlib.sha256(d["text"].encode()).hexdigest())
    got = {r["doc_id"]: (bytes(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(want) > 20 and got == want and [r.kind for r in secrets.MORE] == list(MORE)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_of_odd_tables(spark, request, rows, tmp_path):
    request.getfixturevalue(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
    assert (out.count() > 0) == (rows == "odd")


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_keep_columns(spark, request, rows, sf):
    docs = request.getfixturevalue(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        docs = out.cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_each_operator_has_a_query():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)} and set(registry.QUERIES) | {"pipeline"} <= names

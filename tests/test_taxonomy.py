"""A taxonomy as a table against patterns of the short list, and against looking for every label in every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.operators import match, taxonomy

TAX = "canonical string, category string, synonyms array<string>"
DOCS = "doc_id long, text string"


def brute(texts, rows):
    """Every variant looked for in every text."""
    squeeze = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower()).strip(" ")
    owner = {}
    for name, kind, others in sorted(rows):
        others = [squeeze(o) for o in others]
        for place, v in reversed(list(enumerate([squeeze(name), *others]))):
            if v:
                owner[v] = (name, place, kind, "synonym" if v in others else "exact")
    out = {}
    for doc, text in texts:
        s = squeeze(text or "")
        for v, (name, place, kind, how) in owner.items():
            if v in s and re.search(f"(?<![a-z0-9]){re.escape(v)}(?![a-z0-9])", s):
                out[doc, name] = min(out.get((doc, name), (place, v, kind, how)), (place, v, kind, how))
    return {(doc, name, kind, v, how) for (doc, name), (_, v, kind, how) in out.items()}


def found(spark, texts, rows, **kw):
    got = taxonomy.skills(spark.createDataFrame(texts, DOCS), spark.createDataFrame(rows, TAX), **kw).select("doc_id", "canonical", "category", "variant", "match_type").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_short_list_as_by_patterns(spark):
    r = random.Random(3)
    pool = [v for v, *_ in match.variant_rows()]
    texts = [(k, "".join(r.choice([" ", "  ", "/", "-", ", ", "", "x", ".", "\n", "é"]) + r.choice(pool).title() for _ in range(r.randrange(12)))) for k in range(400)]
    docs = spark.createDataFrame(texts, DOCS)
    want = docs.select("doc_id", F.explode(match.skills_in(F.col("text"))).alias("s")).select("doc_id", "s.canonical", "s.category", "s.variant", "s.match_type")
    rows = [(name, kind, list(others)) for name, (kind, others) in dims.SKILLS.items()]
    assert found(spark, texts, rows) == {tuple(x) for x in want.collect()}


def test_labels_by_the_thousand(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(900)] + ["c++", ".net", "ci/cd", "über", "дизайн", "r", "and", "(x)", "a.b", "\\q", "$1"]
    label = lambda: r.choice([" ", "-", " "]).join(r.choice(words) for _ in range(r.randrange(1, 5)))
    rows = [(label().title(), r.choice(["hard", "soft"]), [label() for _ in range(r.randrange(3))]) for _ in range(20_000)]
    rows = list({name: (name, kind, others) for name, kind, others in rows}.values())
    texts = [(k, "".join(r.choice([" ", " ", "-", ".", "x"]) + r.choice(words) for _ in range(r.randrange(60)))) for k in range(25)]
    got = found(spark, texts, rows)
    assert got == brute(texts, rows) and len(got) > 500


@pytest.mark.parametrize("block", [1, 7, 40])
def test_cuts_and_passes_change_nothing(spark, block):
    r = random.Random(block)
    words = ["aa", "ab", "b", "c++", "#", "ba", "é"]
    rows = [(" ".join(w), "hard", []) for w in {tuple(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(60)}]
    texts = [(k, "".join(r.choice(words) + r.choice([" ", "", ".", "\n "]) for _ in range(80))) for k in range(20)]
    assert found(spark, texts, rows, block=block, at_once=900) == brute(texts, rows)


def test_odd_rows(spark):
    rows = [("Go", None, None), (" ", "hard", ["", "x y"]), ("Go Lang", "hard", ["go", "GO  LANG"])]
    texts = [(1, None), (2, ""), (3, "go"), (3, "go lang"), (None, "X\tY, Go"), (4, "gone x-y")]
    want = {(3, "Go Lang", "hard", "go lang", "synonym"), (None, " ", "hard", "x y", "synonym"), (None, "Go Lang", "hard", "go", "synonym")}
    assert found(spark, texts, rows) == want
    assert found(spark, texts, []) == set() and found(spark, [], rows) == set()


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "python")], DOCS)
    plan = taxonomy.skills(docs, spark.createDataFrame([("Python", "hard", [])], TAX))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan

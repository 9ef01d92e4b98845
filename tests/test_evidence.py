"""Skills in rows against looking for each in each; the plan has no join without keys."""

import random

import pytest

from careerlake.operators import evidence

ROWS = "id long, place long, said string"


def plain(rows, skills, names=4):
    out = {}
    for s in {s for s in skills if s is not None}:
        hits = sorted((p, i) for i, p, t in rows if t is not None and s.lower() in t)
        out[s] = [i for _, i in hits][:names]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_each_skill_in_each_row(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcé \n😀.*") for _ in range(r.randrange(n)))
    rows = [(k % 50, r.randrange(5), r.choice([None, "", text(60)])) for k in range(120)]
    skills = [text(r.choice([2, 3, 7])) for _ in range(80)] + ["", None, "AB", "ab", "ABC", "*", "zzz"]
    df, wanted = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(s, 1) for s in skills], "skill string, names int")
    for at_once in (evidence.SLICE, 1000):
        got = {x["skill"]: x["names"] for x in evidence.evidence(df, wanted, at_once=at_once).collect()}
        assert got == plain(rows, skills)


def test_empty_tables(spark):
    none, rows = spark.createDataFrame([], "skill string"), spark.createDataFrame([(1, 1, "python")], ROWS)
    assert evidence.evidence(rows, none).count() == 0
    assert [tuple(x) for x in evidence.evidence(rows.limit(0), spark.createDataFrame([("Py",)], "skill string")).collect()] == [("Py", [])]


def test_said_and_languages(spark):
    df = spark.createDataFrame([("Go", "My-Repo", None), ("", "x", "Y"), (None, None, None), ("Go", "", "z")], "l string, n string, d string")
    assert [x[0] for x in df.select(evidence.said(df["l"], df["n"], df["d"])).collect()] == ["go my-repo", "x y", "", "go z"]
    assert [tuple(x) for x in evidence.languages(df, "l").collect()] == [("Go", 2)]


def test_no_join_without_keys(spark):
    rows, skills = spark.range(1000).selectExpr("id", "id AS place", "concat('skill', id) AS said"), spark.range(300).selectExpr("concat('L', id) AS skill")
    df = evidence.evidence(rows, skills)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and df.filter("size(names) = 4").count() == 99  # L1 to L99 begin other numbers too

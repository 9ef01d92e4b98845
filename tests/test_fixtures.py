"""Operators on small cases with the whole lists."""

import pytest
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.functions.text import one_of
from careerlake.operators import board, guard, match, report, score, structure


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()), F.lit(0).alias("one"))
    return row.select(column.alias("v")).first()["v"]


def skills(spark, text):
    return {(s["canonical"], s["variant"]) for s in value(spark, match.skills_in(F.col("t")), t=text)}


@pytest.mark.parametrize(
    "text,names",
    [
        ("SQL/Python developer", {"SQL", "Python"}),
        ("python-sql", {"SQL", "Python"}),
        ("emailai, pythonic, javascripts", set()),
        ("React.js and node.js", {"React", "Node.js", "JavaScript"}),
        ("google analytics", {"Google Analytics", "Data Analysis"}),
        ("Critical \n thinking; CROSS-FUNCTIONAL collaboration", {"Problem Solving", "Collaboration"}),
        ("(a/b testing) k8s.", {"A/B Testing", "Kubernetes"}),
        ("", set()),
        (None, set()),
    ],
)
def test_skills_stand_between_other_characters(spark, text, names):
    assert {c for c, _ in skills(spark, text)} == names


def test_first_variant_listed_is_given(spark):
    assert skills(spark, "ms excel and excel and spreadsheets") == {("Excel", "excel")}
    assert {s["match_type"] for s in value(spark, match.skills_in(F.col("t")), t="Python py")} == {"synonym"}


def test_all_variants_are_found_alone_and_side_by_side(spark):
    rows = match.variant_rows()
    assert len(rows) == 115 and len({r[1] for r in rows}) == 38
    df = spark.createDataFrame([(v, c) for v, c, *_ in rows] + [(f"x {v},{w}", c) for (v, c, *_), (w, *_) in zip(rows, rows[1:])], "t string, c string")
    missed = df.filter(~F.exists(match.skills_in(F.col("t")), lambda s: s["canonical"] == F.col("c")))
    assert missed.count() == 0


def test_terms_of_a_pass_never_share_characters():
    import re

    terms = [r[0] for r in match.variant_rows()]
    for one in match.passes(terms):
        for a in one:
            for b in one:
                assert a == b or not match.may_share(a, b)
    assert all(re.fullmatch(one_of(terms), t) for t in terms) and not re.fullmatch(one_of(terms), "pythons")


def test_composite_of_given_scores(spark):
    made = {n: F.lit(v) for n, v in zip(dims.CATEGORY_WEIGHTS, (100.0, 80.0, 55.5, 100.0, 72.5, 92.0, 80.0))}
    want = round(sum(round(v * w, 1) for v, w in zip((100.0, 80.0, 55.5, 100.0, 72.5, 92.0, 80.0), dims.CATEGORY_WEIGHTS.values())), 1)
    assert value(spark, score.composite(made)) == pytest.approx(want)
    assert value(spark, score.content_score(F.lit(0), F.lit(0.5), F.lit(1), F.lit(1.0), F.lit(0), F.lit(0))) == 0
    assert value(spark, score.tailoring_score(F.lit(None).cast("double"), F.lit(1.0), F.lit(True))) == 100
    assert value(spark, score.bias_score(F.lit(9))) == 60 and value(spark, score.seniority_score(F.lit(True))) == 80


TEXT = """Jane Doe
jane@example.com, +91 98765 43210
Professional Summary
Dynamic engineer
Work Experience
Senior Engineer | Acme | Pune Jan 2020 - Present
- Led 5 people
• Responsible for reports
Engineer, Initech 03/2018 to Mar 2021
Built things
Education
B.Tech 1999
Skills
Python, SQL; teamwork"""


def test_a_report(spark):
    docs = spark.createDataFrame([(1, TEXT, "Job title: Senior Engineer\nPython and Docker"), (2, None, None), (3, "", "")], "doc_id long, text string, posting string")
    got = {r["doc_id"]: r for r in report.reports(docs).collect()}
    r = got[1]
    assert (r["contact"]["name"], r["contact"]["email"]) == ("Jane Doe", "jane@example.com") and r["summary"] == "Dynamic engineer"
    assert [(e["title"], e["company"], e["location"], e["start_raw"], e["end_raw"], len(e["bullets"])) for e in r["entries"]] == [("Senior Engineer", "Acme", "Pune", "Jan 2020", "Present", 2), ("Engineer", "Initech", None, "03/2018", "Mar 2021", 1)]
    assert r["skills"] == ["Python", "SQL", "teamwork"] and r["n_overlaps"] == 1 and r["n_gaps"] == 0 and not r["regression"] and r["title_close"]
    assert (r["n_bullets"], r["n_quantified"], r["n_strong"], r["n_weak"], r["n_unsupported"]) == (3, 1, 2, 1, 1)
    assert r["job_tailoring"] == pytest.approx(70 * 0.5 + 20 + 10)
    assert got[2]["n_bullets"] == 0 and "no_bullets" in got[2]["warnings"] and got[3]["content_quality"] == 0


def test_sections_of_one_line_and_of_none(spark):
    of = lambda t: [(s["name"], s["via"], s["lines"]) for s in value(spark, report.sections_of(F.split("t", "\n"), report.marks_of(F.split("t", "\n"))), t=t)]
    assert of("Skills\nPython") == [("skills", "dictionary", ["Python"])]
    assert of("JANE DOE\nSkills") == []
    assert of("just a line of many more words\nx") == [("header_block", "positional_heuristic", ["just a line of many more words", "x"])]


def test_decisions_and_defaults(spark):
    kind = lambda t: value(spark, guard.decision(F.col("t"))["kind"], t=t)
    assert [kind(t) for t in ('{"tool": "x"}', '```json\n{"final": {}}\n```', '{"tool": ""}', '{"tool": "x"', "none")] == ["tool", "final", "invalid", "invalid", "invalid"]
    assert [value(spark, board.hour_block(F.col("t")), t=t) for t in (" 7 h", "-3", "x", "", "12.5")] == [7, -3, 0, 0, 12]
    assert value(spark, structure.month_index(F.col("t")), t="Sept. 2019") == 2019 * 12 + 9


def test_a_line_has_room_above_and_below(spark):
    demand = board.demand_points(*(F.lit(x) for x in (75, 82, 88, 93)))
    assert value(spark, demand) == [75, 79, 82, 85, 88, 93]
    assert value(spark, board.line_points(demand)) == "0.0,29.6 24.0,24.4 48.0,20.6 72.0,16.7 96.0,12.9 120.0,6.4"
    assert value(spark, board.line_points(F.array(F.lit(3.0), F.lit(3.0)))) == "0.0,18.0 120.0,18.0"

"""Steps that read a text once: the same findings as a pattern for each term, without one pass for each."""

import random

from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.operators import detect, match, structure
from careerlake.plans import resumes

PIECES = ["$", " ", "\n", "5", "12", ",", "%", "k", "K", "_", "a", "Zé", "@", ".", "-", "com", "m", "+", "#", "/", "vice president", "Senior", "svp", "vp", "lead", "c++", "go", "node.js", "java", "javascript", "machine learning", "deep learning", "ci/cd", "rest api"]


def texts(seed, n=1500):
    r = random.Random(seed)
    return ["", None, "$ 5", "5k\n", ",%", "1,%", "12_", "a@b.co", "@b.co", "c++", "c+++", "go go", "machine learning deep learning"] + ["".join(r.choice(PIECES) for _ in range(r.randint(1, 8))) for _ in range(n)]


def frame(spark, seed):
    return spark.createDataFrame([(t,) for t in texts(seed)], "t string")


def test_numbers_and_addresses_are_where_their_patterns_match(spark):
    t = F.col("t")
    odd = frame(spark, 1).filter(~detect.quantified(t).eqNullSafe(t.rlike(dims.QUANTIFIED)) | ~detect.has_email(t).eqNullSafe(t.rlike(dims.EMAIL)))
    assert odd.collect() == []


def test_levels_are_those_of_a_pattern_each(spark):
    low = F.lower("t")
    each = F.greatest(*(F.when(low.rlike(f"(^|[^a-z0-9_]){k}($|[^a-z0-9_])"), level) for k, level in dims.SENIORITY.items())).cast("long")
    assert frame(spark, 2).filter(~structure.seniority(F.col("t")).eqNullSafe(each)).collect() == []
    assert len(match.passes(list(dims.SENIORITY), "_")) == 1


def test_terms_are_those_of_a_pattern_each(spark):
    low = F.lower("t")
    for lexicon in (dims.LEXICON, resumes.LEXICON):
        each = F.array_compact(F.array(*(F.when(low.rlike(f"(^|[^a-z0-9+#]){match.quoted(k)}($|[^a-z0-9+#])"), F.lit(k)) for k in lexicon)))
        assert frame(spark, 3).filter(~match.lexicon_skills(F.col("t"), lexicon).eqNullSafe(each)).collect() == []


def test_texts_are_read_a_few_times_not_once_a_term(spark):
    folder = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan(resumes.lexicon_scan(spark, folder)) and plan(resumes.lexicon_scan(spark, folder)).count("regexp_extract_all") <= 2
    assert "RLIKE" not in plan(resumes.keyword_coverage(spark, folder))
    assert "RLIKE" not in plan(resumes.seniority_regression(spark, folder))


def test_dates_of_a_header_are_read_a_few_times(spark):
    from careerlake.plans import reports

    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Present|Current|Now")
    assert times(reports.resume_entries(spark, "/root/testdata/sf0.001")) <= 8
    assert times(reports.bullet_analysis(spark, "/root/testdata/sf0.001")) <= 8


def test_roles_are_not_filtered_before_they_are_gathered(spark):
    plan = resumes.employment_overlaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)present|current|now" not in "".join(x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Filter"))


def test_warnings_read_a_text_a_few_times_and_only_what_they_need(spark):
    from careerlake.plans import reports

    plan = reports.report_warnings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") <= 1 and plan.count("split(btrim(text") <= 1  # lines and words, once each
    assert "array_sort" not in plan
    assert plan.count("[A-Za-z]{3,9}") == 1 and plan.count("(?i)present|current|now") <= 2
    assert dims.PHONE not in plan and dims.URL not in plan  # of other queries


ROUND = ["\n", " ", "\t", "\r", "\v", " " * 110, "Skills", "SKILLS & tools", "s.k.i.l.l.s", "awards", "K", "İ", "é", "_", "-", "•", "▪", "May 2019", "x2012", "2019-05", "12/2010", "2010-1", "March\r2012", "abc", "1", "", "." * 110]


def test_steps_of_the_report_give_what_they_gave_line_by_line(spark):
    from careerlake.functions.text import few_words, word_count, words
    from careerlake.operators import report

    r = random.Random(5)
    made = ["", " ", "\t\n", " " * 130 + "Skills", "Skills" + " " * 130] + ["".join(r.choice(ROUND) for _ in range(r.randint(1, 6))) for _ in range(2000)]
    t, of = F.col("t"), F.split("t", "\n")
    known = F.create_map(*(F.lit(x) for name, all_ in dims.SECTIONS.items() for w in all_ for x in (w, name)))
    each = sum((F.exists(of, lambda x: x.rlike(p)).cast("long") for p in dims.DATE_FORMATS.values()), F.lit(0))  # noqa: B023
    same = {
        "words": word_count(t) == F.size(words(t)),
        "few": few_words(t, 4) == F.size(words(t)).between(1, 4),
        "dates": detect.n_date_formats(of) == each,
        "bullets": F.ltrim(t, F.lit(report.BULLETS)) == F.regexp_replace(t, dims.BULLET, ""),
        "heading": structure.heading_of(t).eqNullSafe(F.try_element_at(known, structure.normal_heading(t))),
    }
    got = spark.createDataFrame([(x,) for x in made], "t string").select("t", *(c.alias(n) for n, c in same.items()))
    assert [x for x in got.collect() if not all(x[n] for n in same)] == []


def test_buzzwords_are_counted_in_lines_without_evidence(spark):
    from careerlake.operators import report

    phrases = list(dims.BUZZWORDS)
    lines = [p.upper() for p in phrases] + [f"x{p}" for p in phrases] + [f"{p}_" for p in phrases] + [f"{p} 5%" for p in phrases] + [f"a {p}, {p}" for p in phrases]
    rows = [(i, f"Experience\nBoss 2019 - 2020\n{x}\nnothing") for i, x in enumerate(lines)]
    found = report.features(report.parsed(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", "n_unsupported").collect()
    n = len(phrases)
    assert [r["n_unsupported"] for r in sorted(found)] == [1] * n + [0] * 3 * n + [2] * n

"""Near matches of names against brute force."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from careerlake.conf import Conf
from careerlake.functions import dims
from careerlake.operators import fuzzy, match


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_score(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200 * plain_lcs(a, b) / (len(a) + len(b))


def plain_runs(text):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def altered(r, name):
    """A name with a few letters lost, doubled, swapped or other, and perhaps its words in another order."""
    s = list(name)
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(s))
        s[k : k + 2] = r.choice([[], s[k : k + 1] * 2, s[k : k + 2][::-1], [r.choice("aeé xé数")], s[k : k + 2]])
        s = s or ["a"]
    words = "".join(s).split()
    r.shuffle(words)
    return " ".join(words)


@pytest.mark.parametrize("at", [75, 85, 100])
def test_near_names_are_those_of_brute_force(spark, at):
    r = random.Random(at)
    names = list(dims.SKILLS)
    texts = [" ".join(altered(r, r.choice(names)) for _ in range(r.randint(1, 12))) for _ in range(120)] + ["", "a", "git", "gits sqls seoo", " ".join(names)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("k", fuzzy.near_names(match.candidates(F.col("t")), names, Conf(fuzzy_at=at)).alias("n")).collect()
    for k, found in got:
        want = {}
        for i, name in enumerate(names):
            best = min(((-plain_score(c, name.lower()), c) for c in plain_runs(texts[k])), default=(0, ""))
            if -best[0] >= at:
                want[i] = (best[1], round(-best[0], 9))
        assert {x["i"]: (x["word"], round(x["score"], 9)) for x in found} == want, texts[k]


def test_joined_names_are_those_of_brute_force(spark):
    r = random.Random(9)
    names = [*dims.SKILLS, "a", "ab", "x" * 70 + " long name of more letters than bits", "naïve bayes"]
    runs = sorted({c for _ in range(300) for c in plain_runs(altered(r, r.choice(names)) + " " + altered(r, r.choice(names)))} | {"a", "x" * 69 + "y long name of more letters than bits", ""})
    got = fuzzy.join_names(spark.createDataFrame([(c,) for c in runs], "word string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(c, n): round(s, 9) for c in runs for n in names if c and (s := plain_score(c, n.lower())) >= 85}
    assert {(x["word"], x["name"]): round(x["score"], 9) for x in got.collect()} == want


def test_second_tier_is_for_what_the_first_missed(spark):
    text = "pythn kubernets, machine learnig; javascript and tablaeu modeling financial " * 2
    found = spark.range(1).select(match.skills_of(F.lit(text)).alias("s")).first()["s"]
    assert (found[0]["canonical"], found[0]["match_type"], found[0]["confidence"]) == ("JavaScript", "synonym", 1.0)
    assert {s["canonical"]: s["variant"] for s in found[1:]} == {"Python": "pythn", "Kubernetes": "kubernets,", "Machine Learning": "machine learnig;", "Tableau": "tablaeu", "Financial Modeling": "modeling financial"}
    assert {s["match_type"] for s in found[1:]} == {"fuzzy"} and {s["confidence"] for s in found if s["canonical"] in ("Python", "Financial Modeling")} == {0.91, 1.0}
    none = spark.range(1).select(match.skills_of(F.lit(None).cast("string")).alias("s")).first()["s"]
    assert none == []


def test_names_too_long_for_a_row_and_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        fuzzy.near_names(F.array(), ["x" * 63])
    with pytest.raises(ValueError):
        fuzzy.near_names(F.array(), ["git"], Conf(fuzzy_at=60))


@pytest.mark.parametrize("at", [75, 85, 100])
def test_runs_near_in_a_whole_text_are_those_of_brute_force(spark, at):
    r = random.Random(at + 1)
    names = [*dims.SKILLS, "naïve bayes", "x" * 70 + " long name of more letters than bits"]
    odd = ["", None, "a", " git\t\nGIT  gits", "modeling\x0bfinancial", "naive bayes naïve bayes", "x" * 69 + "y long name", "y" * 300 + " pythn", " ".join(names)]
    texts = [r.choice([" ", "  ", "\n"]).join(altered(r, r.choice(names)) for _ in range(r.randint(1, 6))) for _ in range(30)] + odd
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = df.select("k", fuzzy.near_in(F.col("t"), names, Conf(fuzzy_at=at)).alias("all"), fuzzy.near_in(F.col("t"), names, Conf(fuzzy_at=at), but_equal=True).alias("other")).collect()
    key = lambda x: " ".join(sorted(x.split(" ")))
    score = functools.cache(lambda a, b: 200 * plain_lcs(key(a), key(b)) / (len(a) + len(b)))
    for k, *found in got:
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", (texts[k] or "").lower()) if w]
        runs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        for of, but in zip(found, (False, True)):
            want = {}
            for i, name in enumerate(names):
                best = min(((-score(c, name.lower()), c) for c in runs if not (but and c == name.lower())), default=(0, ""))
                if -best[0] >= at:
                    want[i] = (best[1], round(-best[0], 9))
            assert {x["i"]: (x["word"], round(x["score"], 9)) for x in of} == want, texts[k]


def test_texts_are_looked_at_in_pieces_and_words_forgotten(spark, monkeypatch):
    whole = fuzzy.Margins(list(dims.SKILLS), 85, 3, False)
    r = random.Random(5)
    texts = [" ".join(altered(r, r.choice(list(dims.SKILLS))).lower() for _ in range(40)).encode() for _ in range(20)]
    want = [whole.near(t) for t in texts]
    monkeypatch.setattr(fuzzy, "AT_ONCE", 2)
    monkeypatch.setattr(fuzzy, "WORDS", 10)
    few = fuzzy.Margins(list(dims.SKILLS), 85, 3, False)
    assert [few.near(t) for t in texts] == want


def test_fuzzy_skills_of_texts_shuffle_nothing(spark):
    from careerlake.plans import resumes

    assert "Exchange" not in resumes.fuzzy_skill_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

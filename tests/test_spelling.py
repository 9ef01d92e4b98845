"""Misspelt words against brute force."""

import itertools
import random
import re

from pyspark.sql import functions as F

from careerlake.operators import nearest, spelling
from careerlake.plans import reports

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def edited(w):
    """All words one edit away."""
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS} | {a + c + b for a, b in cuts for c in LETTERS}


def plain_suggestion(word, dictionary):
    one = edited(word) & dictionary.keys()
    two = one or {x for e in edited(word) for x in edited(e) & dictionary.keys()}
    return min(two, key=lambda x: (-dictionary[x], x)) if two else None


def test_suggestions_are_those_of_brute_force(spark):
    r = random.Random(1)
    base = ["".join(r.choices("abcdeilnorst", k=r.randint(3, 9))) for _ in range(60)]
    rare = set()
    for w in base:
        for _ in range(6):
            s = w
            for _ in range(r.randint(1, 3)):
                s = r.choice(sorted(edited(s)))
            if len(s) > 2:
                rare.add(s)
    counts = {w: r.randint(20, 60) for w in base} | {w: r.randint(1, 19) for w in rare - set(base)}
    known = ["python", "kubernetes"]
    dictionary = {w: n for w, n in counts.items() if n >= 20} | {w: counts.get(w, 0) for w in known}
    counts |= {"pyhton": 3, "kubernets": 2, "kuberntse": 1, "zzzzzzzz": 1}
    got = spelling.suggestions(spark.createDataFrame(list(counts.items()), "word string, n long"), known)
    want = {w: s for w, n in counts.items() if n < 20 and w not in known and (s := plain_suggestion(w, dictionary))}
    assert {x["word"]: x["suggestion"] for x in got.collect()} == want
    assert want["pyhton"] == "python" and want["kubernets"] == "kubernetes" and want["kuberntse"] == "kubernetes" and "zzzzzzzz" not in want


def test_lost_added_changed_and_swapped_letters_of_each_document(spark):
    texts = ["house garden " * 20, "huse\nhosue huse", "houses, Huse gaarden, garten www.huse.com a@huse.com http://huse", None, "", "pythn is known", "hoouuse ga'den\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted([(1, "huse", "house", 2), (1, "hosue", "house", 1), (2, "houses", "house", 1), (2, "gaarden", "garden", 1), (2, "garten", "garden", 1), (5, "pythn", "python", 1), (6, "hoouuse", "house", 1)])
    for most in (2_000_000, 0):
        got = sorted(tuple(x) for x in spelling.misspelt(docs, most=most).filter("suggestion IN ('house', 'garden', 'python')").collect())
        assert got == want
    assert spelling.misspelt(docs.limit(0)).collect() == []


def test_words_in_common_letters_are_found_without_comparing_all(spark):
    plan = spelling.suggestions(spark.createDataFrame([("abc", 30)], "word string, n long"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)
    two = [("ca", "abc"), ("abcd", "badc"), ("abcd", "acbdx"), ("abc", "cab"), ("abcd", "dcba"), ("ab", "ba"), ("abcdef", "abdcfe")]
    got = spark.createDataFrame(two, "a string, b string").select(spelling.within(F.col("a"), F.col("b"), 2), spelling.within(F.col("a"), F.col("b"), 1)).collect()
    assert [tuple(x) for x in got] == [(any(b in edited(e) for e in edited(a) | {a}), b in edited(a)) for a, b in two]


def test_pieces_of_rare_words_are_not_shuffled(spark):
    counts = spark.createDataFrame([("planet", 90), ("plant", 30), ("plnet", 1), ("planett", 2), ("xyz", 1)], "word string, n long")
    seen = []
    keep = spelling.stored
    spelling.stored = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df)
    try:
        found = {r["word"]: r["suggestion"] for r in spelling.suggestions(counts, []).collect()}
    finally:
        spelling.stored = keep
    assert found == {"plnet": "planet", "planett": "planet"}
    assert sum("rightHint=(strategy=broadcast)" in p for p in seen) == 2


def misspellings():
    """A word, and 60,000 that are two letters off it."""
    word = "internationalization"
    places = itertools.islice(((i, j, a, b) for i, j in itertools.combinations(range(20), 2) for a in LETTERS for b in LETTERS if a != word[i] and b != word[j]), 60_000)
    return word, [word[:i] + a + word[i + 1 : j] + b + word[j + 1 :] for i, j, a, b in places]


def joins(df):
    return re.findall(r"(SortMergeJoin|BroadcastHashJoin) [^\n]*\], (\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_misspelt_words_by_the_ten_thousand_are_not_broadcast(spark):
    """60,000 misspelt words; before, up to 2,000,000 were sent through the driver."""
    word, wrong = misspellings()
    docs = spark.createDataFrame([(1, f"{word} " * 20), (2, " ".join(wrong)), (3, wrong[7])], "doc_id long, text string")
    made = spelling.misspelt(docs, [])
    assert joins(made) == [("SortMergeJoin", "Inner"), ("BroadcastHashJoin", "LeftAnti")]
    got = made.groupBy("doc_id", "suggestion").agg(F.count("*").alias("n"), F.sum("n").alias("lines")).collect()
    assert sorted(map(tuple, got)) == [(2, word, 60_000, 60_000), (3, word, 1, 1)]


def test_reports_with_misspelt_words_by_the_ten_thousand_are_not_made_through_the_driver(spark, tmp_path):
    word, wrong = misspellings()
    docs = spark.createDataFrame([(1, f"{word} " * 20, "web"), (2, " ".join(wrong[:30_000]) + "\n" + " ".join(wrong[20_000:]), "web"), (6, None, None)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = reports.report_spelling(spark, str(tmp_path)).select("doc_id", "misspelt")
    assert ("SortMergeJoin", "Inner") in joins(made) and ("BroadcastHashJoin", "Inner") not in joins(made)
    found = {r["doc_id"]: r["misspelt"] for r in made.collect()}
    assert found.keys() == {1, 2, 6} and found[2] - 70_000 in range(30) and found[1] < 30 and found[6] < 30


def test_pieces_of_words_are_not_made_and_parts_of_a_dictionary_give_the_same(spark, monkeypatch):
    r = random.Random(2)
    base = ["".join(r.choices("abcde", k=r.randint(3, 7))) for _ in range(50)]
    counts = {r.choice(sorted(edited(r.choice(sorted(edited(w)))))): r.randint(1, 19) for w in base for _ in range(4)} | {w: r.randint(20, 40) for w in base}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {tuple(x) for x in spelling.suggestions(table, ["abcd"]).collect()}
    seen, keep, parts = [], spelling.stored, []
    monkeypatch.setattr(spelling, "AT_ONCE", 9)
    monkeypatch.setattr(spelling, "stored", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    monkeypatch.setattr(nearest, "nearest", lambda asked, part, edits, of=nearest.nearest: parts.append(part.num_rows) or of(asked, part, edits))
    assert {tuple(x) for x in spelling.suggestions(table, ["abcd"]).collect()} == want and len(want) > 50
    assert not any("Generate" in p for p in seen) and len(parts) >= 12 and max(parts) < 25


def distance(a, b):
    """Fewest letters lost, added, changed or swapped with a neighbour, in any order."""
    d, last = {(-1, j): len(a) + len(b) for j in range(-1, len(b) + 1)} | {(i, -1): len(a) + len(b) for i in range(-1, len(a) + 1)}, {}
    for i in range(len(a) + 1):
        seen = 0
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            x, y = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            seen = j if same else seen
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i - 1, j] + 1, d[i, j - 1] + 1, d[x - 1, y - 1] + i - x + j - y - 1)
        if i:
            last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_the_nearest_of_short_and_long_words_is_that_of_brute_force():
    for seed, (letters, least, most) in enumerate([("ab", 0, 6), ("abcdefgh", 2, 12), ("abc", 26, 36), ("aé漢b", 28, 34), ("abcdef", 40, 50)]):
        r = random.Random(seed)
        base = ["".join(r.choices(letters, k=r.randint(least, most))) for _ in range(20)]

        def wrong():
            w = r.choice(base)
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(w) + 1)
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
            return w

        words, asked = list(dict.fromkeys(wrong() for _ in range(40))), [wrong() for _ in range(60)]
        near = [[distance(a, w) for w in words] for a in asked]
        for edits in (1, 2):
            assert nearest.Nearest(words, edits).of(asked).tolist() == [next((k for k, d in enumerate(row) if d <= edits), len(words)) for row in near]
    assert nearest.Nearest([], 2).of(["abc", ""]).tolist() == [0, 0]


def test_words_of_thousands_of_letters():
    r = random.Random(3)
    word = "".join(r.choices(LETTERS, k=5000))
    asked = [word[:99] + "é" + word[100:4000] + word[4001:], word[:2500] + word[2501] + word[2500] + word[2502:], word[3:], word[:-2]]
    assert nearest.Nearest(["abc", word], 2).of(asked).tolist() == [1, 1, 2, 1]

"""Source divergences, document fingerprints and filter interactions against brute force."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from careerlake.llm import divergence, filters, sketches
from careerlake.llm.common import dealt_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id long, quality int, toxic int"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def from_sql(tmp_path, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    return con.execute(sql)


# op11


def plain_divergence(rows, least, top):
    """rows: lang, source, text."""
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    count, in_docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        for t, n in Counter(terms).items():
            count[lang or "", source or "", t] += n
            in_docs[lang or "", t] += 1
    kept = defaultdict(list)
    for (lang, t), n in in_docs.items():
        if n >= least:
            kept[lang].append(t)
    share = lambda n, size, v: 1 + 10**9 * (n + 2) // (size + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, q = {}, {}
    for lang, terms in kept.items():
        here = [s for x, s in groups if x == lang]
        sizes = {s: sum(count[lang, s, t] for t in terms) for s in here}
        for t in terms:
            q[lang, t] = share(sum(count[lang, s, t] for s in here), sum(sizes.values()), len(terms))
            for s in here:
                p[lang, s, t] = share(count[lang, s, t], sizes[s], len(terms))
    out = []
    for lang, source in groups:
        pairs = [(-sum(f(p[lang, source, t], p[lang, s, t]) for t in kept[lang]), s.encode()) for x, s in groups if x == lang and s != source]
        terms = [(-f(p[lang, source, t], q[lang, t]), t.encode()) for t in kept[lang] if count[lang, source, t] and p[lang, source, t] > q[lang, t]]
        out += [(lang, source, "pair", item.decode(), -value, k) for k, (value, item) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", item.decode(), -value, k) for k, (value, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(map(repr, out))


def drawn_rows(r, n):
    words = ["".join(r.choices("abcDEfé数Ω", k=r.randint(1, 4))) for _ in range(60)]
    return [(r.choice(["en", "de", None]), r.choice(["web", "a", "数", None]), r.choice(["", None, " ".join(r.choices(words, k=r.randint(1, 40)) + ["x9y-Z"])])) for _ in range(n)]


@pytest.mark.parametrize("bucket", [divergence.BUCKET, 7])
@pytest.mark.parametrize("most_groups", [divergence.MOST_GROUPS, 0])
def test_divergences_are_brute_force(spark, monkeypatch, bucket, most_groups):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "with_groups", lambda kept, groups, f=divergence.with_groups: f(kept, groups, most_groups))
    monkeypatch.setattr(divergence, "dealt_join", lambda *a, **k: dealt_join(*a, **k, least=2))
    rows = drawn_rows(random.Random(3), 300) + [("it", "a", "one two"), ("it", "b", None)]  # a language that keeps nothing
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert rows_of(divergence.audit(docs)) == plain_divergence(rows, divergence.LEAST_DOCS, divergence.TOP)


def test_divergences_of_odd_rows_are_the_sql(spark, odd, none, tmp_path):
    many = odd.unionByName(odd).unionByName(odd)
    theirs = from_sql(tmp_path, divergence.oracle(), documents=many)
    names = [c[0] for c in theirs.description]
    assert rows_of(divergence.audit(many).select(*names)) == sorted(map(repr, theirs.fetchall()))
    assert divergence.audit(none).collect() == []


@pytest.mark.parametrize("digest", [lambda b: len(b) % 3, lambda b: 7])
def test_terms_with_one_hash_are_told_apart(digest):
    r = random.Random(1)
    words = ["".join(r.choices("abc", k=r.randint(1, 3))).encode() for _ in range(400)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = divergence.boundaries(data, np.array([0, len(data)]))
    term, firsts = divergence.grouped(data, starts, ends, digest)
    raw = data.tobytes()
    names = [raw[starts[k] : ends[k]] for k in firsts]
    assert len(set(names)) == len(names) and [names[t] for t in term] == words


def test_terms_end_where_texts_do():
    texts = ["ab", "", "cd e", None, "-f", "g-", "", "é"]
    part = pa.RecordBatch.from_arrays([pa.array(["x"] * 8), pa.array(["y"] * 8), pa.array([t or "" for t in texts])], names=["lang", "source", "text"])
    for given in (part, pa.concat_tables([pa.Table.from_batches([part])] * 2).combine_chunks().to_batches()[0].slice(8)):
        assert divergence.counted(given).column(2).to_pylist() == sorted(["ab", "cd", "e", "f", "g", "é"], key=divergence.counted(given).column(2).to_pylist().index)
        assert sorted(divergence.counted(given).column(2).to_pylist()) == ["ab", "cd", "e", "f", "g", "é"]
    assert [s.num_rows for s in divergence.slices_of(part, 3)] == [2, 1, 2, 2, 1] or sum(s.num_rows for s in divergence.slices_of(part, 3)) == 8


def test_shares_are_exact_for_large_counts(spark):
    r = random.Random(2)
    pairs = [(n, n + r.randrange(1, 8 * 10**15 - n)) for n in (r.randrange(10 ** r.randint(1, 15)) for _ in range(300))]
    exact = [1 + 10**9 * n // d for n, d in pairs]
    assert divergence.share(np.array([n for n, _ in pairs]), np.array([d for _, d in pairs])).tolist() == exact
    made = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, n long, d long").selectExpr("k", f"{divergence.share_sql('n', 'd')} AS p")
    assert [p for _, p in sorted(map(tuple, made.collect()))] == exact


# op12


def plain_sketch(text, fraction=sketches.FRACTION):
    words = WORD.findall(text)
    runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    hashes = sorted({hashlib.md5(x.encode()).hexdigest()[:16] for x in runs})
    return [h for h in hashes if int(h, 16) < fraction * 2**64] or hashes[:1]


def plain_likeness(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))


def plain_fingerprints(rows):
    """rows: doc_id, text."""
    rows = [(k, t or "") for k, t in rows]
    ids = sorted({k for k, _ in rows}, key=lambda k: (k is None, k or 0))
    stands = {k: min((t for i, t in rows if i == k), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for k in ids}
    out = []
    for k, t in rows:
        after = stands[ids[(ids.index(k) + 1) % len(ids)]]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + after[:quarter]
        a, b, c = map(plain_sketch, (t, edited, after))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [10_000, 2])
def test_fingerprints_are_brute_force(spark, odd, odd_rows, monkeypatch, least):
    monkeypatch.setattr(sketches, "dealt_join", lambda *a, **k: dealt_join(*a, **k, least=least))
    r = random.Random(4)
    words = ["".join(r.choices("abcé数🙂", k=3)) for _ in range(50)]
    more = [(r.randrange(-500, 500), " ".join(r.choices(words, k=r.randint(0, 300)))) for _ in range(150)] + [(9, "copy of one text " * 30)] * 40
    rows = [row[:2] for row in odd_rows] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(sketches.compared(docs)) == plain_fingerprints(rows)
    assert rows_of(sketches.compared(odd)) == plain_fingerprints([row[:2] for row in odd_rows])


def test_fingerprints_of_no_and_one_row(spark, none):
    assert sketches.compared(none).collect() == []
    for one in [(1, "a b c d e f g h")], [(None, None)]:
        assert rows_of(sketches.compared(spark.createDataFrame(one, "doc_id long, text string"))) == plain_fingerprints(one)


def test_fingerprints_use_no_python_worker_and_send_texts_once(spark, sf):
    plan = sketches.op12_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("small,large", [(60, 6000), (500, 5000)])
def test_containment_of_unequal_texts_and_merged_sketches(spark, small, large):
    """Exactly that of brute force for each pair, and on average that of the texts."""
    rows, pairs, r = [], {}, random.Random(small)
    for k in range(20):
        words = [f"w{r.randrange(10**6)}" for _ in range(large)]
        inside = words[large // 3 : large // 3 + small] + [f"v{r.randrange(10**6)}" for _ in range(small)]
        rows += [(f"whole{k}", " ".join(words[: large // 2 + 4])), (f"whole{k}", " ".join(words[large // 2 :])), (f"part{k}", " ".join(inside))]
        pairs[f"part{k}", f"whole{k}"] = set(plain_sketch(" ".join(inside), 1 / 2)), set(plain_sketch(" ".join(words), 1 / 2))
    made = spark.createDataFrame(rows, "name string, text string").withColumn("sketch", sketches.sketch(sketches.F.col("text"), 1 / 2))
    merged = sketches.merged(made, "name", 1 / 2).cache()
    assert sorted((n, h) for n, h in merged.collect()) == sorted((n, h) for names, both in pairs.items() for n, x in zip(names, both) for h in x)
    found = sketches.containments(merged.filter("name LIKE 'part%'"), merged.filter("name LIKE 'whole%'").withColumnRenamed("name", "other"), "name", "other").collect()
    assert {(x["name"], x["other"]): (x["shared"], x["contained"]) for x in found} == {k: (len(a & b), len(a & b) / len(a)) for k, (a, b) in pairs.items()}
    assert abs(np.mean([x["contained"] for x in found]) - (small - 4) / (2 * small - 4)) < 0.05


def test_a_merged_sketch_keeps_the_least_hash(spark):
    texts = ["only three words", "just four words here"]
    assert all(int(plain_sketch(t, 1e-6)[0], 16) >= 1e-6 * 2**64 for t in texts)
    made = spark.createDataFrame([(1, t) for t in texts] + [(2, ""), (None, "x")], "k int, text string").withColumn("sketch", sketches.sketch(sketches.F.col("text"), 1e-6))
    assert [tuple(x) for x in sketches.merged(made, "k", 1e-6).collect()] == [(1, min(plain_sketch(t, 1e-6)[0] for t in texts))]


# op13


def plain_audit(rows, labels):
    """rows: doc_id, text, lang."""
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    low, docs = {}, []
    for k, t, _ in rows:
        if k is not None:
            low[t or ""] = min(k, low.get(t or "", k))
    for k, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > low[t]]
        docs.append((lang or "", {f for f, x in zip("ABCDE", fails) if x}, k in good, k in toxic))
    out, removed_by = [], Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                all_ = [d for d in docs if d[0] == part and f in d[1]]
                removed_by[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), len(all_) - len(gone), sum(d[1] == {f} for d in all_), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted(repr((*x, removed_by[x[0], x[1][x[2] - 1]])) for x in out)


def drawn_docs(r, n):
    texts = []
    for _ in range(n // 3):
        words = ["".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(r.choice([3, 30, 600]))]
        texts.append(" ".join(r.choices(words, k=r.choice([150, 199, 200, 260]))) + r.choice(["", " A" * 30, " #", " $ X", "\n"]))
    return [(r.choice([k, k, 5, None]), r.choice(texts), r.choice(["en", "de", None])) for k in range(n)]


@pytest.mark.parametrize("least", [10_000, 2])
def test_interactions_are_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(filters, "dealt_join", lambda *a: dealt_join(*a, least=least))
    r = random.Random(6)
    rows = drawn_docs(r, 240)
    labels = [(r.choice([r.randrange(240), None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert rows_of(filters.interactions(docs, spark.createDataFrame(labels, LABELS))) == plain_audit(rows, labels)


def test_interactions_of_odd_rows(spark, odd, odd_rows, none, tmp_path):
    labels = [(0, 1, 1), (0, 0, 0), (3, 1, 0), (None, 1, 1), (7, None, 1)]
    marks = spark.createDataFrame(labels, LABELS)
    ours = filters.interactions(odd, marks)
    assert rows_of(ours) == plain_audit([row[:3] for row in odd_rows], labels)
    theirs = from_sql(tmp_path, filters.oracle(), documents=odd, labels=marks)
    names = [c[0] for c in theirs.description]
    assert rows_of(ours.select(*names)) == sorted(map(repr, theirs.fetchall()))
    assert filters.interactions(none, marks).collect() == []
    assert {r["good_lost"] for r in filters.interactions(odd, marks.limit(0)).collect()} == {0}


def test_shapley_values_add_up(spark, sf):
    made = [r for r in filters.op13_filter_audit(spark, sf).collect() if r["part"] == "en"]
    by_filter = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in made}
    lost = {r["kept"] for r in made if r["step"] == 5}
    first = [r for r in made if r["filter_order"] == "ABCDE" and r["step"] == 1][0]
    assert len(lost) == 1 and sum(by_filter.values()) == 120 * (first["kept"] + first["removed"] - lost.pop())
    assert all(Fraction(v, 120) >= 0 for v in by_filter.values()) and os.path.exists(sf)

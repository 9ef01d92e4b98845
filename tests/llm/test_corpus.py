"""Operators over the corpus, against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from careerlake.llm import classifier, mixing, registry, rules, simhash, templates
from careerlake.llm.common import dealt_join


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    every = sorted(set(prints))
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for p, i in zip(prints, ids):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def test_simhash_rows(odd, odd_rows, none):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=repr)
    prints = [plain_fingerprint(r[1] or "") for r in odd_rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(odd_rows, prints, plain_components(prints, [r[0] for r in odd_rows]))]
    assert got == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("few", [4096, 3])
def test_trie_finds_every_link(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    values = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for s in seeds for _ in range(12)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = {(x["x"], x["y"]) for x in simhash.trie_self_join(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_one_of_each_component_stays(spark, odd, odd_rows, sf):
    kept = simhash.keep_first(spark, odd, sf)
    assert kept.columns == odd.columns
    groups = len(set(plain_components([plain_fingerprint(r[1] or "") for r in odd_rows], range(len(odd_rows)))))
    assert kept.count() == groups


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "x long, y long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_common_keys_are_dealt_out(spark):
    rows = [(7, k) for k in range(500)] + [(k % 50, k) for k in range(500)] + [(None, 1)] * 20
    big = spark.createDataFrame(rows, "k long, v long").repartition(5)
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    want = sorted(map(tuple, big.join(small.drop("n"), "k").collect()))
    dealt = dealt_join(big, small, ["k"], least=10)
    assert sorted(map(tuple, dealt.collect())) == want and dealt.columns == ["k", "v", "m"]
    # half the rows have one key: no task gets them all
    parts = dealt.filter("k = 7").groupBy(F.spark_partition_id()).count().count()
    assert parts > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert dealt_join(big.limit(0), small.limit(0), ["k"]).count() == 0


def test_a_star_with_half_of_the_links_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "dealt_join", lambda *a: dealt_join(*a, least=10))
    links = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(100)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{k: 0 for k in range(400)}, **{1000 + k: 1000 for k in range(101)}}


def test_half_of_the_rows_are_copies(spark, monkeypatch, sf):
    monkeypatch.setattr(simhash, "dealt_join", lambda *a: dealt_join(*a, least=10))
    docs = spark.createDataFrame([(k, "the same words in each of these texts" if k % 2 else f"text {k} " * 9, "a", "b") for k in range(300)] + [(None, None, "a", "b")] * 150, "doc_id long, text string, __text_hash string, __n string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    prints = [plain_fingerprint("the same words in each of these texts" if k % 2 else f"text {k} " * 9) for k in range(300)] + [0]
    want = plain_components(prints, [*range(300), None])
    assert got == dict(zip(range(300), want))
    kept = simhash.keep_first(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == len({c for c in plain_components(prints, range(301))})
    assert {tuple(r)[2:] for r in kept.collect()} == {("a", "b")}


def test_first_of_two_columns(spark, sf):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(spark, docs, sf).collect()), key=repr) == [(1, "a b c"), (3, None)]


# ------------------------------------------------------------ classifier


def test_ridge_is_the_normal_equations_of_all_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(*map(int, draw.integers(1, 300, len(rules.STATS))), int(draw.integers(0, 2))) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in rules.STATS) + ", quality int").repartition(7)
    frame = df.toPandas()
    cosines = classifier.Cosines(*classifier.moments(df))
    x = classifier.features(frame)
    assert np.allclose(cosines.mean, x.mean(0)) and np.allclose(cosines.spread, x.std(0))
    z, y = cosines(frame), frame["quality"].to_numpy(float)
    want = np.linalg.solve(z.T @ z + classifier.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(classifier.ridge(df, cosines), want)
    # the cosines approximate a Gaussian kernel
    s = ((x - x.mean(0)) / x.std(0)).clip(-8, 8)[:60]
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / (2 * classifier.WIDTH**2))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - kernel).mean() < 0.1


def test_pooling_is_the_best_rising_fit():
    r = np.random.default_rng(4)
    for _ in range(50):
        n = int(r.integers(1, 9))
        y, w = r.random(n), r.integers(1, 5, n).astype(float)
        middles, means = classifier.pooled(list(range(n)), y.tolist(), w.tolist())
        got, at = [], 0
        for middle, mean in zip(middles, means):  # a block ends where its weighted middle is reached
            end = next(e for e in range(at + 1, n + 1) if np.isclose(np.average(np.arange(at, e), weights=w[at:e]), middle))
            got += [mean] * (end - at)
            at = end
        assert at == n
        # of all ways to cut into blocks, that with rising means and the least squares
        best = None
        for cut_ in range(1 << (n - 1)):
            blocks = np.split(np.arange(n), [i + 1 for i in range(n - 1) if cut_ >> i & 1])
            means = [np.average(y[b], weights=w[b]) for b in blocks]
            if all(a <= b for a, b in zip(means, means[1:])):
                fit = np.concatenate([np.full(len(b), m) for b, m in zip(blocks, means)])
                cost = (w * (y - fit) ** 2).sum()
                best = (cost, fit) if best is None or cost < best[0] - 1e-12 else best
        assert np.allclose(got, best[1])


def test_held_out_rows_are_ranked(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = classifier.op2_quality_classifier(spark, folder)
    rows = out.filter("held_out").join(labels, "doc_id").select("score", "quality", "predicted").toPandas()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    area = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)
    assert area > 0.85, area
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3).astype(int) == rows.predicted).all()


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = classifier.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.score_quality(none, labels).count() == 0
    blind = classifier.score_quality(odd, labels.filter("doc_id < 0")).collect()
    assert len(blind) == len(rows) and all(r["score"] is not None for r in blind)


def test_scores_rise():
    x, y = classifier.pooled([1, 2, 3, 4], [0.1, 0.5, 0.3, 0.9], [1, 1, 1, 1])
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0.1, 0.4, 0.9]


# ------------------------------------------------------------ mixing


def test_mixing_of_odd_rows_is_its_sql(spark, odd, odd_rows, none, tmp_path):
    con = duckdb.connect()
    odd.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "d.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet')")
    want = con.execute(registry.SQL["op10_mixing"]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in mixing.mixture(odd).collect()]
    near = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(got) == near(want)
    assert mixing.mixture(none).count() == 0


TARGETS = {"source": {"web": 0.5, "nowhere": 0.1}, "lang": {"en": 0.4, "de": 0.4, "fr": 0.1, "es": 0.1}}


@pytest.mark.parametrize("targets", [None, TARGETS])
def test_raking_in_spark_is_that_on_the_driver(spark, sf, targets, monkeypatch):
    monkeypatch.setattr(mixing, "dealt_join", lambda *a: dealt_join(*a, least=2))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("source", F.lit("hot")))  # half of all rows
    made = mixing.described(docs)
    cells = mixing.cells_of(docs.select(*(c.alias(n) for n, c in made.items())))
    one, two = (mixing.rake_cells(cells, targets, most=m, rounds=3)[0].toPandas().sort_values(mixing.KEYS).reset_index(drop=True) for m in (1000, 0))
    assert one[mixing.KEYS].equals(two[mixing.KEYS]) and (one.p - two.p).abs().max() < 1e-9 and (one.w - two.w).abs().max() < 1e-6


def test_rows_of_many_cells_are_those_of_few(spark, odd, monkeypatch, sf):
    monkeypatch.setattr(mixing, "dealt_join", lambda *a: dealt_join(*a, least=2))
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    few, many = (mixing.rake_cells(mixing.cells_of(odd.select(*(c.alias(n) for n, c in mixing.described(odd).items()))), most=m, rounds=2)[0] for m in (1000, 0))
    assert key(few.selectExpr("__source", "__lang", "__topic", "round(p, 9)").collect()) == key(many.selectExpr("__source", "__lang", "__topic", "round(p, 9)").collect())
    rows = odd.select("doc_id", *(c.alias(n) for n, c in mixing.described(odd).items()))
    assert key(mixing.with_cells(rows, few, False).select("doc_id", "__tokens").collect()) == key(mixing.with_cells(rows, few, True).select("doc_id", "__tokens").collect())


def plain_raking(cells, targets, rounds, fraction=None):
    """Expected tokens, and goals; cells: (source, lang, topic) -> tokens."""
    fraction = mixing.FRACTION if fraction is None else fraction
    total = sum(cells.values())
    goals = []
    for k, d in enumerate(mixing.DIMENSIONS):
        own = {}
        for c, n in cells.items():
            own[c[k]] = own.get(c[k], 0) + n
        own = {v: n for v, n in own.items() if n}
        given = targets.get(d, {})
        even = {v: n**mixing.EVENNESS for v, n in own.items() if v not in given}
        left = max(0, 1 - sum(x for v, x in given.items() if v in {c[k] for c in cells}))
        goal = {v: given[v] if v in given else even[v] / sum(even.values()) * left for v in own}
        goals.append({v: x / sum(goal.values()) for v, x in goal.items()})
    of = lambda k, v: sum(n for c, n in cells.items() if c[k] == v)
    most = min((of(k, v) / x / total for k, goal in enumerate(goals) for v, x in goal.items() if x), default=1)
    fraction = min(fraction, max(0.95 * most, min(0.05, fraction)))
    w = {c: n * fraction for c, n in cells.items()}
    for _ in range(rounds):
        for k, goal in enumerate(goals):
            now = {}
            for c, x in w.items():
                now[c[k]] = now.get(c[k], 0) + x
            w = {c: min(cells[c], x * goal.get(c[k], 0) * fraction * total / now[c[k]]) if now[c[k]] else 0.0 for c, x in w.items()}
    return w, goals


@pytest.mark.parametrize("given", [None, {"lang": {"en": 0.4, "de": 0.3}}, {"topic": {"contact": 0.05, "figures": 0.1}}])
def test_sampled_shares_meet_targets(spark, given):
    """Within half a point, expected and (as far as some thousand documents tell) drawn."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").cache()
    said = mixing.marginals(docs, given).collect()
    assert all(abs(r["sampled"] - r["target"]) < 0.005 and r["met"] for r in said)
    rows = mixing.mixture(docs, targets=given).toPandas()
    drawn = rows[rows.sampled]
    for d in ("lang", "topic"):
        shares = drawn.groupby(d).n_tokens.sum() / drawn.n_tokens.sum()
        assert all(abs(shares.get(r["value"], 0) - r["target"]) < 0.03 for r in said if r["dimension"] == d)
    assert abs((rows.probability * rows.n_tokens * rows.weight).sum()) > 0 and abs((rows.weight * rows.n_tokens).sum() / rows.n_tokens.sum() - 1) < 1e-3


def test_targets_out_of_reach_are_named(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs, {"topic": {"contact": 0.9}}).collect()}
    assert not said["topic", "contact"]["met"] and said["topic", "contact"]["sampled"] > 2 * said["topic", "contact"]["own"]
    rows = mixing.mixture(docs, targets={"topic": {"contact": 0.9}}).toPandas()
    assert rows[rows.topic == "contact"].probability.max() == 1 and (rows.probability <= 1).all()


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first = docs.select("source").distinct().orderBy("source").first()[0]
    targets = {"source": {first: 0.5, "nowhere": 0.2}, "lang": {"en": 0.4, "de": 0.3}}
    cells = mixing.cells_of(docs.select(*(c.alias(n) for n, c in mixing.described(docs).items())))
    got = mixing.rake_cells(cells, targets)[0].toPandas()
    want, goals = plain_raking({tuple(r[k] for k in mixing.KEYS): float(r["tokens"]) for r in cells.collect()}, targets, mixing.ROUNDS)
    assert all(abs(want[tuple(r[k] for k in mixing.KEYS)] - r["w"]) < 1e-6 * (1 + r["w"]) for _, r in got.iterrows())
    said = {(r["dimension"], r["value"]): r for r in mixing.marginals(docs, targets).collect()}
    for d, goal in zip(mixing.DIMENSIONS, goals):
        for v, x in goal.items():
            assert abs(said[d, v]["target"] - x) < 1e-9 and abs(said[d, v]["sampled"] - x) < 0.005
    assert said["lang", "en"]["target"] == pytest.approx(0.4)
    for fraction, reached in ((0.05, 0.05), (0.3, 0.95 * min(r["own"] / r["target"] for r in said.values() if r["target"]))):  # 0.3 leaves the first source short
        rows = mixing.mixture(docs, fraction, targets).toPandas()
        assert abs((rows.probability * rows.n_tokens).sum() / rows.n_tokens.sum() - min(fraction, reached)) < 0.001
    with pytest.raises(ValueError):
        mixing.mixture(docs, targets={"lang": {"en": 1.2}})


# ------------------------------------------------------------ pages

ARTICLE = "<html><head><title>T</title><style>p {{}}</style></head><body><header>Site</header><nav><a href='/'>Home</a></nav><div class='notice'>Cookies!</div><article><h1>{0} title</h1><p>First &amp; {0}\n  line.</p><p>Second <b>bo</b>ld {0}</p></article><aside>More</aside><div class='comments'><p>Nice!</p></div><footer>(c)</footer><script>var x = '<p>no</p>';</script></body></html>"
DIVS = "<html><body><div id='top'>Shop name</div><div class='text'><p>Long body of page {0} with its own words {0} {0}.</p><p>And another paragraph {0}.</p></div><div>Same on all pages</div></body></html>"


def test_pages(spark):
    rows = [(k, f"https://a.example/{k}", ARTICLE.format(f"n{k}")) for k in range(8)] + [(100 + k, f"https://b.example/{k}", DIVS.format(f"n{k}")) for k in range(12)]
    rows += [(200, None, None), (201, "::odd::", ""), (202, "https://c.example/", "plain text only"), rows[0], (None, None, ARTICLE.format("x"))]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()), key=repr)
    texts = {k: f"n{k} title First & n{k} line. Second bold n{k}" for k in range(8)} | {100 + k: f"Long body of page n{k} with its own words n{k} n{k}. And another paragraph n{k}." for k in range(12)}
    texts |= {200: "", 201: "", 202: "plain text only", None: "x title First & x line. Second bold x"}
    assert got == sorted(((i, texts[i], len(texts[i])) for i, _, _ in rows), key=repr)


def test_no_pages(spark):
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

"""Template deduction against brute force, and pages that names tell nothing about."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from careerlake.llm import pages, templates

SITE = ["Shop name and slogan", "Free delivery from ten", "Open every day till late", "Write to us"]


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def plain_site(r, k, by="div"):
    """A page without article or telling classes: slogan, links, rotating advert, title, author, text, links to others, footer."""
    title, author, parts = words(r, 4), f"By {words(r, 2)}", [words(r, r.randint(5, 60)) for _ in range(r.randint(1, 5))]
    head = f"<html><head><title>{title} - Shop</title></head><body><div class=a1>{SITE[0]}</div><div class=a2><ul>" + "".join(f"<li><a href=/{w}>{w}</a>" for w in ("home", "all", "new")) + "</ul></div>"
    text = f"<{by} class=b0><h1>{title}</h1><div class=b1>{author}</div><div class=b2>" + "".join(f"<p>{p}" for p in parts) + f"</div></{by}>"
    rest = f"<div class=c1>{SITE[k % 4]}</div><div class=c2>Company &copy; <b>{SITE[(k + 1) % 4]}</b></div></body></html>"
    return head + text + rest, " ".join([title, author, *parts])


def extracted(spark, rows, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in templates.extract(df, **how).collect()}


@pytest.mark.parametrize("broadcast", [templates.BROADCAST, 0])
def test_pages_without_telling_names(spark, broadcast):
    r = random.Random(1)
    made = [plain_site(r, k) for k in range(40)]
    rows = [(k, f"https://www.one.example/{k}", p) for k, (p, _) in enumerate(made)]
    assert extracted(spark, rows, broadcast=broadcast) == {k: t for k, (_, t) in enumerate(made)}
    by_names = extracted(spark, rows, use_templates=False)
    assert all(by_names[k] != t for k, (_, t) in enumerate(made))


def other_site(r, k):
    """Another layout of the same host: links at the end, two columns, nothing of plain_site's classes."""
    title, parts = words(r, 3), [words(r, r.randint(8, 50)) for _ in range(r.randint(1, 3))]
    page = f"<html><head><title>{title}</title></head><body><section class=qa><div class=qb>{SITE[2]}</div><div class=qc><p>{SITE[k % 4]}</div></section><section class=qd><div class=qe><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in parts)}</div>"
    page += f"<div class=qf><ul><li><a href=/a>first</a><li><a href=/b>second</a></ul></div></section><div class=qg>{SITE[0]}</div><div class=qh>&copy; Company</div></body></html>"
    return page, " ".join([title, *parts])


@pytest.mark.parametrize("n,other", [(20, 10), (20, 3), (8, 2), (40, 20)])
@pytest.mark.parametrize("broadcast", [templates.BROADCAST, 0])
def test_each_layout_of_a_host_has_its_template(spark, n, other, broadcast):
    r = random.Random(n + other)
    made = [(other_site if k < other else plain_site)(r, k) for k in range(n)]
    rows = [(k, "https://mixed.example/x", p) for k, (p, _) in enumerate(made)]
    assert extracted(spark, rows, broadcast=broadcast) == {k: t for k, (_, t) in enumerate(made)}


@pytest.mark.parametrize("n", [2, 3, 4])
def test_hosts_of_few_pages(spark, n):
    r = random.Random(n)
    made = [plain_site(r, k) for k in range(n)]
    made = [(p.replace(SITE[(k + 1) % 4], SITE[1]).replace(f"<div class=c1>{SITE[k % 4]}", f"<div class=c1>{SITE[2]}"), t) for k, (p, t) in enumerate(made)]  # so few pages can't tell a rotating advert
    assert extracted(spark, [(k, "https://few.example/", p) for k, (p, _) in enumerate(made)]) == {k: t for k, (_, t) in enumerate(made)}


def test_a_page_alone_in_its_layout_takes_another_that_fits(spark):
    r = random.Random(11)
    made = [plain_site(r, k) for k in range(12)]
    page, text = plain_site(r, 12)
    odd = page.replace("<div class=c1>", "<dl class=ra><dt>a<dd class=rb>b</dl><table class=rc><tr class=rd><td class=re>c</table><ol class=rf><li class=rg>d</ol><div class=c1>")
    rows = [(k, "https://one.example/", p) for k, (p, _) in enumerate([*made, (odd, text)])]
    assert extracted(spark, rows) == {k: t for k, (_, t) in enumerate([*made, (odd, text)])}


@pytest.mark.parametrize("n", [2, 20])
def test_constant_parts_of_an_article_stay(spark, n):
    r = random.Random(12)
    made = [(f"<body><div class=x>{SITE[0]}</div><article><h1>{(t := words(r, 3))}</h1><div><p>Serves four people.</p></div><p>{(p := words(r, 40))}</p></article><div class=y>{SITE[3]}</div></body>", f"{t} Serves four people. {p}") for _ in range(n)]
    assert extracted(spark, [(k, "http://cook.example/", p) for k, (p, _) in enumerate(made)]) == {k: t for k, (_, t) in enumerate(made)}


def test_layouts_are_those_of_brute_force(spark):
    r = random.Random(13)
    rows = [("h", (other_site if k % 3 else plain_site)(r, k)[0]) for k in range(18)] + [("one", "<p>a"), ("two", "<p>a<b>"), ("two", "<p>b")]
    record = templates.records(spark.createDataFrame(rows, "host string, html string"))
    got = {(x["host"], x["token"]): x["weight"] for x in templates.layouts(record).collect()}
    want = {}
    for host in ("h", "one", "two"):
        stands = defaultdict(set)
        for k, html in enumerate(x for h, x in rows if h == host):
            for t in {templates.ROOT, *(e.token for e in pages.tokenised(html)[0] if e.what == pages.START)}:
                stands[t].add(k)
        classes = defaultdict(list)
        for t, where in stands.items():
            classes[frozenset(where)].append(t)
        want |= {(host, min(ts)): round(1000 * len(ts) * math.log1p(len(where))) for where, ts in classes.items() if len(where) >= 2}
    assert got == want


def test_flat_pages_go_by_slots(spark):
    r = random.Random(2)
    rows, want = [], {}
    for k in range(30):
        title, parts = words(r, 3), [words(r, 30) for _ in range(r.randint(1, 4))]
        rows.append((k, "http://flat.example/", f"<body><div class=x>{SITE[k % 3]}</div><h1>{title}</h1><h2>Summary</h2>{''.join(f'<p>{p}</p>' for p in parts)}<div class=y>{SITE[3]}</div></body>"))
        want[k] = " ".join([title, "Summary", *parts])
    assert extracted(spark, rows) == want


def test_constant_headings_in_the_text_stay_and_copies_count_once(spark):
    r = random.Random(3)
    made = [(f"<body><div class=x>{SITE[0]}</div><div class=t><h1>{(t := words(r, 3))}</h1><h2>Summary</h2><p>{(p := words(r, 40))}</p></div></body>", f"{t} Summary {p}") for _ in range(8)]
    made += [made[0]] * 60
    assert extracted(spark, [(k, "http://copies.example/", p) for k, (p, _) in enumerate(made)]) == {k: t for k, (_, t) in enumerate(made)}


def test_odd_tables(spark):
    r = random.Random(4)
    long_ = "<body><article><p>" + words(r, 60_000) + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "::", "a &lt; b"), (None, None, None), (4, "http://x.example", "<p>tie"), (4, "http://x.example", "<p>tie"), (5, "http://x.example", long_)]
    df = spark.createDataFrame([(*x, "mine", 7, "k") for x in rows], "page_id long, url string, html string, host string, template int, text string")
    got = sorted(((x["page_id"], x["text"]) for x in templates.extract(df).collect()), key=repr)
    text = long_.partition("<p>")[2].removesuffix("</article>")
    assert got == sorted([(1, ""), (2, ""), (3, "a < b"), (None, ""), (4, "tie"), (4, "tie"), (5, text)], key=repr)
    assert templates.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("broken", ["<a b ", "<div>", "<p><b>x", '<a b="x> ', "<a b='\"> y", "<div><p>a</div>", "<q x=\"> <b c='>", "<x-y>", "</div>", "<!-- ", "<", "<script>"])
def test_broken_pages_take_time_in_proportion(broken):
    page = broken * (1_000_000 // len(broken))
    began = time.process_time()
    pages.tokenised(page)
    assert time.process_time() - began < 5


def test_classes_are_those_of_brute_force(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        cells = "".join(f"<div class=row><section class=left>{words(r, 2)}</section><section class=right>{words(r, 3)}</section></div>" for _ in range(r.randint(1, 4)))
        shuffled = [f"<div class=m{i}>{words(r, 2)}</div>" for i in range(2)]
        r.shuffle(shuffled)
        rows.append(("h", f"<body><div class=list>{cells}</div>{''.join(shuffled)}<ol>{'<li>x' * r.randint(1, 3)}</ol></body>"))
    rows += [("small", "<p>a")] * 3  # copies: one page, which has no template
    df = spark.createDataFrame(rows, "host string, html string")
    record = templates.records(df)
    found = templates.anchored(record, templates.supported(record)).collect()
    vectors, sequences = defaultdict(Counter), []
    for k, (_, html) in enumerate(x for x in rows if x[0] == "h"):
        seen = [e.token for e in pages.tokenised(html)[0] if e.what == pages.START]
        sequences.append(seen)
        for t in [templates.ROOT, *seen]:
            vectors[t][k] += 1
    want = {t: frozenset(v.items()) for t, v in vectors.items() if len(v) >= templates.SUPPORT * len(sequences)}
    assert {x["host"] for x in found} == {"h"} and {x["token"] for x in found} == set(want)
    groups = defaultdict(set)
    for t, v in want.items():
        groups[v].add(t)
    assert {frozenset(x["token"] for x in found if x["class"] == c) for c in {x["class"] for x in found}} == set(map(frozenset, groups.values()))
    for v, tokens in groups.items():
        rounds = [[t for t in s if t in tokens] for s in sequences]
        common = Counter(tuple(x[: len(tokens)]) if x == x[: len(tokens)] * (len(x) // len(tokens)) else () for x in rounds).most_common(1)[0]
        valid = len(tokens - {templates.ROOT}) > 1 and common[0] and common[1] >= templates.SUPPORT * len(sequences)
        once = all(n == 1 for _, n in v)
        assert {x["anchor"] for x in found if x["token"] in tokens} == {bool(valid or once)}


def test_slots_are_those_of_brute_force(spark):
    r = random.Random(6)
    rows = [("h", plain_site(r, k)[0]) for k in range(25)]
    record = templates.records(spark.createDataFrame(rows, "host string, html string"))
    found = templates.anchored(record, templates.supported(record)).filter("anchor")
    anchors, want = {x["token"] for x in found.collect()}, defaultdict(list)
    for _, html in rows:
        slot, mine = 0, defaultdict(list)
        for e in pages.tokenised(html)[0]:
            if e.what == pages.TEXT:
                mine[slot].append(e)
            elif e.token in anchors:
                slot = e.token if e.what == pages.START else -e.token
        for s, events in mine.items():
            want[s].append(events)
    expected = {s: (len({tuple(e.text for e in x) for x in all_}), sum(len(e.text) for x in all_ for e in x)) for s, all_ in want.items()}
    got = {x["slot"]: (x["texts"], x["chars"]) for x in templates.slots(record, found).collect()}
    assert got == expected

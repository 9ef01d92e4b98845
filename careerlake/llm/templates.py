"""Main text of web pages, by the template that the pages of a host share.

A page is a row of tokens (pages.py): elements told apart by their path, and texts. Over the different pages of a host each token has an
occurrence vector; tokens with equal vectors form an equivalence class. Pages of one layout share many tokens that other pages lack, so
classes name the layouts of a host: a page's layout is the class in it with most weight, its tokens times the logarithm of its pages, and
one template is deduced for each layout. Over the pages of a layout a class (now with how often each token stands in each page) has
support if it stands in nearly all of them, and is valid if its tokens come in the same order, round after round, in nearly all; of a
class that isn't, the tokens that stand once a page are classes of their own. Valid classes nest by the paths of their tokens, which
gives the template: a tree of elements with slots between their starts and ends. The texts that fill a slot tell what it is: in a page's
own text they differ from page to page, in menus, notices, adverts and footers they are the same few, or links.

The main text is what stands in the smallest element of the template that holds MOST of the characters of such slots, widened while
that adds nothing but such slots. In it goes what its name or class says to be something else (comments, forms, adverts) and, unless it
is an article element, parts whose text never changes; nothing else is dropped. Where that element is the whole body, its other parts go
by their slots. A page without a layout that others have, or that lacks the main element, takes the next of the host's templates that fits
it; only where there is none, as on a host of one page, do names of elements and classes decide alone.

Vectors are fingerprints that add up over pages, so no host is ever gathered: what is collected of a host are its templates, at most the
tokens of a page / SUPPORT each, and a token for each class. Exact copies of a page count once. The tokens, a tenth of the pages, are stored; the texts are not, but read
again at the end, which costs less than a second copy of the pages on disk.

Null html counts as empty and gives text ''. A null or odd url counts as host ''. Repeated rows stay, row for row. An empty table
gives an empty result. Very long pages take time and memory in proportion to their length; broken tags are read once. Ties: of equally
common orders of a class any decides, as none then has support. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import SLICE, by_text, cut, ship, table, written
from careerlake.llm.pages import CONTAINER, END, HEADING, NONE, OUTER, PIECE, START, TEXT, Event, tokenised

#: Share of a layout's different pages that a template token stands in; pages that a layout has at least, as one alone repeats nothing.
SUPPORT, FEW = 0.9, 2
#: Share of the characters of a host's own texts that the main element holds; texts of a slot, as a share of the slot with most, from which it counts as own.
MOST, OWN = 0.6, 0.5
#: Parts into which a host's tokens or pages are dealt.
SALTS = 32
#: Bytes of templates that are broadcast; with more, pages are joined with them by shuffles.
BROADCAST = 32 << 20
ROOT = 0
#: Stands between the templates of a host.
BETWEEN = "\x1e"

COUNTED = pa.struct([("token", pa.int64()), ("times", pa.int32()), ("parent", pa.int64()), ("kind", pa.int32())])
FILLED = pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32()), ("links", pa.int32())])
RECORD = pa.schema([("page", pa.int64()), ("tokens", pa.list_(pa.int64())), ("starts", pa.list_(COUNTED)), ("texts", pa.list_(FILLED))])
RECORD_DDL = "page long, tokens array<long>, starts array<struct<token:long,times:int,parent:long,kind:int>>, texts array<struct<at:int,hash:long,chars:int,links:int>>"


def text_hash(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def record(page: str) -> tuple:
    """A page's hash, its tokens in order (ends negative), how often each starts, and what its texts are, by the number of tokens before them."""
    tokens, starts, texts = [], {ROOT: [1, -1, OUTER]}, []
    for e in tokenised(page)[0]:
        if e.what == TEXT:
            texts.append({"at": len(tokens), "hash": text_hash(e.text), "chars": len(e.text), "links": e.links})
        else:
            tokens.append(e.token if e.what == START else -e.token)
            if e.what == START:
                starts.setdefault(e.token, [0, e.parent, e.kind])[0] += 1
    return text_hash(page), tokens, [{"token": t, "times": n, "parent": p, "kind": k} for t, (n, p, k) in starts.items()], texts


def records(pages: DataFrame) -> DataFrame:
    """host, and the record of each different page of it."""
    source = pages.select("host", F.coalesce("html", F.lit("")).alias("html"))
    rows = by_text(source, RECORD, RECORD_DDL, lambda texts: list(map(record, texts)), ("host",), "html")
    return written(rows.groupBy("host", "page").agg(*(F.first(c).alias(c) for c in ("tokens", "starts", "texts"))))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit("")))


def layouts(rows: DataFrame) -> DataFrame:
    """host, token, weight: of each class of tokens that stand in the same pages of a host, two or more, one token that tells it."""
    each = rows.select("host", "page", F.explode("starts").alias("t")).select("host", "page", "t.token")
    vectors = each.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page")).alias("vector"), F.count("*").alias("n_pages")).filter(F.col("n_pages") >= FEW)
    classes = vectors.groupBy("host", "vector", "n_pages").agg(F.min("token").alias("token"), F.count("*").alias("size"))
    return classes.select("host", "token", F.round(1000 * F.col("size") * F.log1p("n_pages")).cast("long").alias("weight"))


@lru_cache(maxsize=500)
def weightiest(template: str) -> tuple[int, ...]:
    return tuple(t for t, w in sorted(numbers_of(template), key=lambda x: (-x[1], x[0])))


def ranked_layouts(template: str, tokens: set[int]) -> list[int]:
    """Layouts of a page with these tokens, by their tokens, the weightiest first; template: token and weight of a host's layouts."""
    return [t for t in weightiest(template) if t in tokens]


def by_layout(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with host and layout, a line each, in place of host; rows of hosts without layouts are left out."""
    joined = joined_by_host(rows, lines_of(found, "token", "weight")).filter("template IS NOT NULL").select("host", "template", "page", "tokens", "starts", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                # the page itself is a token of every page, so that none is without
                sites = [f"{host}\n{(ranked_layouts(t, {ROOT, *tokens}) or [ROOT])[0]}" for host, t, tokens in zip(*(part.column(i).to_pylist() for i in (0, 1, 3)))]
                yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), *part.columns[2:]], names=["host", "page", "tokens", "starts", "texts"])

    return written(joined.mapInArrow(run, f"host string, {RECORD_DDL}"))


def supported(rows: DataFrame) -> DataFrame:
    """host, token, class, once, parent, kind, host_pages of tokens with support, of hosts with FEW pages or more."""
    each = rows.select("host", "page", F.explode("starts").alias("t")).select("host", "page", "t.*")
    vectors = each.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
        F.count("*").alias("n_pages"),
        F.sum("times").alias("times"),
        F.max("parent").alias("parent"),
        F.max("kind").alias("kind"),
    )
    sizes = vectors.filter(F.col("token") == ROOT).select("host", F.col("n_pages").alias("host_pages")).filter(F.col("host_pages") >= FEW)
    # most tokens of a large host go here, so they are dealt by host and token
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = vectors.withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"]).filter(F.col("n_pages") >= F.lit(SUPPORT) * F.col("host_pages"))
    return found.select("host", "token", F.xxhash64("vector", "n_pages", "times").alias("class"), (F.col("times") == F.col("n_pages")).alias("once"), "parent", "kind", "host_pages")


def joined_by_host(rows: DataFrame, per_host: DataFrame, most: int = BROADCAST) -> DataFrame:
    """rows with the string `template` of their host, or null; hosts are dealt in SALTS parts where the strings are too large to broadcast."""
    if (per_host.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0) <= most:
        return rows.join(F.broadcast(per_host), "host", "left")
    salted = per_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"], "left").drop("__salt")


def lines_of(found: DataFrame, *columns: str) -> DataFrame:
    """host, template: a line of numbers for each row of found."""
    line = F.concat_ws(" ", *(F.col(c).cast("long").cast("string") for c in columns))
    return found.groupBy("host").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("template"))


@lru_cache(maxsize=500)
def numbers_of(template: str) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(map(int, line.split(" "))) for line in template.split("\n") if line)


def each_page(rows: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, fn: Callable[..., list[tuple]]) -> DataFrame:
    """host and the rows that fn makes of template and the columns of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                made = [(host, *row) for host, template, *rest in zip(*(c.to_pylist() for c in part.columns)) if template for row in fn(template, *rest)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*made), schema)], schema=schema)

    return rows.select("host", "template", *columns).mapInArrow(run, ddl)


def orders(template: str, tokens: list[int]) -> list[tuple[int, int]]:
    """Of each class of more tokens than one in a page: its order, as a number above 0, or 0 where the page doesn't have them round after round."""
    class_of = {token: c for token, c in numbers_of(template)}
    rounds: dict[int, list[int]] = {}
    for t in tokens:
        if t in class_of:
            rounds.setdefault(class_of[t], []).append(t)
    out = []
    for c, seen in rounds.items():
        k = len(set(seen))
        out.append((c, text_hash(str(seen[:k])) + 1 if len(seen) % k == 0 and seen == seen[:k] * (len(seen) // k) else 0))
    return out


def anchored(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with `anchor`: whether the token is of a valid class, or by itself once a page."""
    sizes = found.groupBy("host", "class").agg(F.count("*").alias("size"))
    many = found.join(sizes.filter("size > 1"), ["host", "class"], "left_semi")
    schema = pa.schema([("host", pa.string()), ("class", pa.int64()), ("order", pa.int64())])
    seen = each_page(joined_by_host(rows.select("host", "tokens"), lines_of(many, "token", "class")), ["tokens"], schema, "host string, class long, order long", orders)
    counts = seen.groupBy("host", "class", "order").agg(F.count("*").alias("n"))
    best = counts.groupBy("host", "class").agg(F.max(F.struct("n", "order")).alias("best"), F.sum("n").alias("n"))
    valid = best.filter((F.col("best.order") != 0) & (F.col("best.n") >= F.lit(SUPPORT) * F.col("n"))).select("host", "class", F.lit(True).alias("valid"))
    return found.join(valid, ["host", "class"], "left").withColumn("anchor", F.coalesce("valid", F.lit(False)) | F.col("once")).drop("valid")


def fillings(template: str, tokens: list[int], texts: list[dict]) -> list[tuple[int, int, int, int]]:
    """Of each slot with text in a page: the anchor's start or (negative) end before it, hash of its texts, their characters, and those in links."""
    anchors = {t for (t,) in numbers_of(template)}
    found: dict[int, list[int]] = {}
    slot = k = 0
    for text in texts:
        while k < text["at"]:
            if abs(tokens[k]) in anchors:
                slot = tokens[k]
            k += 1
        had = found.setdefault(slot, [0, 0, 0])
        had[0], had[1], had[2] = text_hash(f"{had[0]} {text['hash']}"), had[1] + text["chars"], had[2] + text["links"]
    return [(s, *v) for s, v in found.items()]


def slots(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """host, slot, texts (different ones), chars, links."""
    schema = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])
    each = each_page(joined_by_host(rows.select("host", "tokens", "texts"), lines_of(anchors, "token")), ["tokens", "texts"], schema, "host string, slot long, hash long, chars long, links long", fillings)
    different = each.groupBy("host", "slot", "hash").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    return different.groupBy("host", "slot").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))


class Slot(NamedTuple):
    element: int
    own: bool
    texts: int
    chars: int


def chosen(nodes: tuple[tuple[int, ...], ...], filled: tuple[tuple[int, ...], ...]) -> str | None:
    """The main element, and the elements and slots in it that go, and headings outside of it that stay, as lines; None where the slots tell nothing.

    nodes: token, parent, kind, once, anchor of the template; filled: slot, texts, chars, links.
    """
    parent, kind = {t: p for t, p, *_ in nodes}, {t: k for t, _, k, *_ in nodes}
    once, anchors = {t for t, _, _, o, _ in nodes if o}, {t for t, *_, a in nodes if a}

    def line(t: int) -> list[int]:
        """A token and those around it."""
        out = []
        while t in parent:
            out.append(t)
            t = parent[t]
        return out

    most = max((texts for _, texts, _, _ in filled), default=0)
    if most < 2:
        return None
    found: dict[int, Slot] = {}
    for slot, texts, chars, links in filled:
        at = slot if slot >= 0 else next((t for t in line(parent[-slot]) if t in anchors), ROOT)
        found[slot] = Slot(at, texts >= max(2, OWN * most) and 2 * links <= chars, texts, chars)
    inside: dict[int, list[int]] = {}
    for slot, s in found.items():
        for t in line(s.element):
            inside.setdefault(t, []).append(slot)
    mass = {t: sum(found[s].chars for s in all_ if found[s].own) for t, all_ in inside.items()}
    whole = sum(s.chars for s in found.values() if s.own)
    may = [t for t in inside if t in once and kind[t] in (CONTAINER, OUTER, PIECE) and mass[t] >= MOST * whole]
    main = max(may, key=lambda t: (len(line(t)), t), default=ROOT)
    up = main
    while kind.get(up) != OUTER and (up := parent.get(up, ROOT)) in inside and kind[up] != OUTER:
        more = [s for s in inside[up] if s not in inside[main]]
        if not all(found[s].own for s in more):
            break
        if more:
            main = up
    outer = kind.get(main, OUTER) == OUTER
    within = inside.get(main, [])
    template = lambda s: not s.own if outer else s.texts == 1
    article = any(kind[t] == PIECE for t in line(main))
    gone = [t for t in inside if not article and kind[t] == CONTAINER and t != main and main in line(t) and all(template(found[s]) for s in inside[t])]
    gone_slots = [s for s in within if outer and not found[s].own and kind.get(found[s].element) != HEADING]
    stay = [] if any(kind.get(found[s].element) == HEADING for s in within) else [found[s].element for s in found if found[s].own and kind.get(found[s].element) == HEADING and s not in within]
    return "\n".join(" ".join(map(str, x)) for x in ([main], sorted(gone), sorted(gone_slots), sorted(set(stay)), sorted(anchors) if gone_slots else []))


def regions(found: DataFrame, filled: DataFrame) -> DataFrame:
    """host, template: what chosen() says of the host."""
    nodes = lines_of(found, "token", "parent", "kind", "once", "anchor").withColumnRenamed("template", "nodes")
    both = nodes.join(lines_of(filled, "slot", "texts", "chars", "links"), "host").select("host", "nodes", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [chosen(numbers_of(n), numbers_of(t)) for n, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["host", "template"])

    return both.mapInArrow(run, "host string, template string").filter("template IS NOT NULL")


class Region(NamedTuple):
    main: int
    gone: frozenset[int]
    gone_slots: frozenset[int]
    headings: frozenset[int]
    anchors: frozenset[int]


@lru_cache(maxsize=500)
def region(template: str) -> Region:
    main, *rest = ([int(x) for x in line.split(" ") if x] for line in template.split("\n"))
    return Region(main[0], *map(frozenset, rest))


def by_names(events: list[Event], asides: list[tuple[int, int, bool]]) -> list[str]:
    """Texts outside of asides: those in articles, or where there is none all."""
    gone = [False]
    for up, reason, _ in asides[1:]:
        gone.append(gone[up] or reason != NONE)
    kept = [(e.main, e.text) for e in events if e.what == TEXT and not gone[e.aside]]
    return [text for main, text in kept if main] or [text for _, text in kept]


def by_template(r: Region, events: list[Event], asides: list[tuple[int, int, bool]]) -> list[str] | None:
    """Texts in the main element; None where the page hasn't got it."""
    out, headings, depth, dropped, slot, around, seen = [], [], 0, 0, 0, 0, r.main == ROOT
    heading = 0
    if seen:
        depth = 1

    def aside(k: int) -> bool:
        """Whether an aside that stands in the main element holds it."""
        while k and k != around:
            up, reason, _ = asides[k]
            if reason != NONE:
                return True
            k = up
        return False

    for e in events:
        if e.what == TEXT:
            if depth and not dropped and slot not in r.gone_slots and not aside(e.aside):
                out.append(e.text)
            elif heading and not seen:
                headings.append(e.text)
            continue
        step = 1 if e.what == START else -1
        if e.token == r.main:
            if step > 0 and not depth:
                around = e.aside
            depth, seen = depth + step, True
        elif e.token in r.gone:
            dropped += step
        elif e.token in r.headings:
            heading += step
        if e.token in r.anchors:
            slot = step * e.token
    return headings + out if seen else None


@lru_cache(maxsize=500)
def known(template: str) -> tuple[tuple[int, int, str], ...]:
    """Token, weight and region of a host's layouts, the weightiest first."""
    parts = (p.split("\n", 1) for p in template.split(BETWEEN))
    return tuple(sorted(((*map(int, head.split(" ")), rest) for head, rest in parts), key=lambda x: (-x[1], x[0])))


def main_text(page: str, template: str | None) -> str:
    events, asides = tokenised(page)
    if template:
        tokens = {ROOT, *(e.token for e in events if e.what == START)}
        for _, _, rest in sorted(known(template), key=lambda x: x[0] not in tokens):
            found = by_template(region(rest), events, asides)
            if found is not None:
                return " ".join(found)
    return " ".join(by_names(events, asides))


def templates(pages: DataFrame) -> DataFrame:
    """host, template of the hosts of pages (host, html): for each layout its token, its weight and the lines of chosen()."""
    rows = records(pages)
    kinds = cut(layouts(rows))
    sites = by_layout(rows, kinds)
    found = cut(anchored(sites, cut(supported(sites))))
    chosen_ = regions(found, slots(sites, found.filter("anchor")))
    of = chosen_.select(F.substring_index("host", "\n", 1).alias("host"), F.substring_index("host", "\n", -1).cast("long").alias("token"), F.col("template").alias("region"))
    named = of.join(kinds, ["host", "token"])
    line = F.concat(F.col("token").cast("string"), F.lit(" "), F.col("weight").cast("string"), F.lit("\n"), F.col("region"))
    return cut(named.groupBy("host").agg(F.concat_ws(BETWEEN, F.array_sort(F.collect_list(line))).alias("template")))


def extract(pages: DataFrame, use_templates: bool = True, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    ship(pages.sparkSession)
    hosted = with_host(pages.select("page_id", "url", "html"))
    joined = joined_by_host(hosted, templates(hosted), broadcast) if use_templates else hosted.withColumn("template", F.lit(None).cast("string"))
    joined = joined.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                texts = [main_text(h, s) for h, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                made = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["page_id", "url", "text", "n_chars"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:2])
    return joined.mapInArrow(run, f"{kept}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
SQL: dict[str, str] = {}

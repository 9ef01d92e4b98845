"""How far sources of a language differ in their words, exactly.

Texts are cut as bytes: a table of 256 entries says which bytes are of terms, and where that changes in the buffer of many texts laid end
to end, a term begins or ends. Terms are grouped by XXH64, and every one is compared byte by byte with the first of its hash; those that
differ from it are grouped anew. A slice of texts gives its counts by language, source and term, which Spark adds up. A language keeps
the terms of LEAST_DOCS of its documents or more.

Divergences of all pairs of sources are sums over terms, so terms are dealt into buckets: a bucket is a matrix of sources by terms in
compressed rows. For each source its shares are laid out over the bucket's terms, the divergence of every stored count from them is
computed at once, and reduceat sums these by source. Terms that a pair both lack share one value. Sums of the buckets are added by Spark.
A bucket has BUCKET counts, or more where that many pairs of sources are to be returned, MOST at most.

Shares are whole numbers of 1e-9, by long division in base 1000, so nothing overflows while a language has less than 9e15 tokens.

Null text, lang and source count as ''. A row is a document: repeated rows and ids count each. Texts without terms have their group in
the result all the same. Equal values are ranked by item. A very long text takes memory in proportion to its length. An empty table gives
an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerlake.llm.common import cut, dealt_join, ship, table, written

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of texts that are cut at a time, but for a longer single text.
SLICE_BYTES = 4 << 20
BUCKET, MOST = 20_000, 4_000_000
#: Groups that are broadcast; more are joined by shuffles.
MOST_GROUPS = 200_000

IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS_DDL = "lang string, source string, term string, n long, docs long"
SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
SUMS_DDL = "lang string, a string, b string, value long"


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end in texts laid end to end; offsets: where texts start, and the end of the last."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_TERM[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether slices a have the bytes of slices b, pair by pair; no slice is empty."""
    sizes = ends - starts
    out = sizes[a] == sizes[b]
    like = np.flatnonzero(out)
    if len(like):
        n = sizes[a[like]]
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        unlike = data[np.repeat(starts[a[like]], n) + within] != data[np.repeat(starts[b[like]], n) + within]
        out[like] = np.add.reduceat(unlike, first, dtype=np.int64) == 0
    return out


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice's term, and of each term the first slice with it."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    term, firsts, n = np.empty(len(starts), np.int64), [], 0
    todo = np.arange(len(starts))
    while len(todo):
        _, first, at = np.unique(hashes[todo], return_index=True, return_inverse=True)
        same = same_bytes(data, starts, ends, todo, todo[first][at])
        term[todo[same]] = at[same] + n
        firsts.append(todo[first])
        n, todo = n + len(first), todo[~same]  # other bytes with the same hash
    return term, np.concatenate(firsts) if firsts else np.empty(0, np.int64)


def counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n, docs of the rows of part: lang, source, text."""
    texts = part.column(2)
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = LOWER[np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]]] if whole is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends = boundaries(data, offsets)
    term, firsts = grouped(data, starts, ends)
    langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
    by_source = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
    doc = np.searchsorted(offsets, starts, "right") - 1
    n_terms = max(1, len(firsts))
    keys, n = np.unique(by_source[doc] * n_terms + term, return_counts=True)
    in_docs = np.unique(doc * n_terms + term)
    _, docs = np.unique(by_source[in_docs // n_terms] * n_terms + in_docs % n_terms, return_counts=True)
    raw = data.tobytes()
    terms = pa.array([raw[a:b] for a, b in zip(starts[firsts].tolist(), ends[firsts].tolist())], pa.binary()).cast(pa.string())
    group = keys // n_terms
    columns = langs.dictionary.take(pa.array(group // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(group % max(1, len(sources.dictionary)))), terms.take(pa.array(keys % n_terms))
    return pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=COUNTS)


def slices_of(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in a row with `most` bytes of text together, or one row."""
    size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2).cast(pa.large_binary())])
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at, before = end, size[end - 1]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (places), docs (documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch):
                yield counted(part)

    ship(docs.sparkSession)
    source = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return source.mapInArrow(run, COUNTS_DDL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n of the terms that a language keeps, total (n of the language), first (true in one row of each term)."""
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    return written(counts.filter(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "first"))


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (n summed), lang_size, terms (kept by the language), entries (counts of the group), buckets (of the language)."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("entries"), F.sum(F.col("first").cast("long")).alias("terms"))
    by_lang = Window.partitionBy("lang")
    own = groups.join(sizes, ["lang", "source"], "left").fillna(0, ["size", "entries", "terms"])
    own = own.withColumns({"lang_size": F.sum("size").over(by_lang), "terms": F.sum("terms").over(by_lang), "all": F.sum("entries").over(by_lang), "sources": F.count("*").over(by_lang)})
    room = F.least(F.greatest(F.lit(BUCKET), 4 * F.col("sources") * F.col("sources")), F.lit(MOST))
    return cut(own.withColumn("buckets", F.greatest(F.ceil(F.col("all") / room), F.lit(1)).cast("int")).drop("all", "sources"))


def share(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / size), for n <= size < 9e15."""
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // size, rest % size
    return out + 1


def share_sql(n: str, size: str) -> str:
    """The same as SQL."""
    rest, out = n, "0"
    for _ in range(3):
        out, rest = f"({out} * 1000 + ({rest}) * 1000 div ({size}))", f"(({rest}) * 1000 % ({size}))"
    return f"(1 + {out})"


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(source: np.ndarray, term: np.ndarray, n: np.ndarray, sizes: np.ndarray, n_terms: int, kept: int) -> np.ndarray:
    """The divergence of each pair of sources over the bucket's terms; source, term, n: the counts, sorted by source; sizes: of all sources."""
    many = len(sizes)
    size = sizes + 2 * kept
    starts = np.searchsorted(source, np.arange(many + 1))
    stored = np.diff(starts)
    full = np.flatnonzero(stored)
    p, none = share(n + 2, size[source]), share(np.full(many, 2), size) if kept else np.ones(many, np.int64)
    out = np.zeros((many, many), np.int64)
    if n_terms == 0:
        return out
    summed = lambda x: np.add.reduceat(x, starts[full], dtype=np.int64) if len(full) else x[:0]
    for a in range(many):
        own = slice(starts[a], starts[a + 1])
        shares, has = np.full(n_terms, none[a]), np.zeros(n_terms, bool)
        shares[term[own]], has[term[own]] = p[own], True
        both = has[term]
        f = divergences(p, shares[term])
        out[a, full] += summed(f)  # terms of the other source
        out[full, a] += summed(np.where(both, 0, f))  # those of the other that a lacks, once more from its side
        shared = np.zeros(many, np.int64)
        shared[full] = summed(both.astype(np.int64))
        out[a] += (n_terms - stored[a] - stored + shared) * divergences(none, none[a])
    return out


def bucket_pairs(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, a, b, value of all pairs of sources of the language, a before b."""
    names = np.array(groups["source"].to_pylist(), object)
    order = np.argsort(names, kind="stable")
    names, sizes = names[order], groups["size"].to_numpy()[order].astype(np.int64)
    place = {name: k for k, name in enumerate(names)}
    source = np.array([place[s] for s in entries["source"].to_pylist()], np.int64)
    by_source = np.argsort(source, kind="stable")
    terms = entries["term"].combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    values = pair_sums(
        source[by_source], terms.indices.to_numpy()[by_source].astype(np.int64), entries["n"].to_numpy()[by_source].astype(np.int64), sizes, len(terms.dictionary), int(groups["terms"][0].as_py())
    )
    a, b = np.triu_indices(len(names), 1)
    lang = groups["lang"][0].as_py()
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(names[a].tolist(), pa.string()), pa.array(names[b].tolist(), pa.string()), pa.array(values[a, b], pa.int64())], schema=SUMS)


def with_groups(kept: DataFrame, groups: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """kept with the columns of its group; groups are broadcast within `most` rows, else common ones are dealt out."""
    if groups.count() <= most:
        return kept.join(F.broadcast(groups.drop("entries")), ["lang", "source"])
    return dealt_join(kept, groups.drop("entries"), ["lang", "source"], counts=groups.select("lang", "source", F.col("entries").alias("n")))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = kept_terms(docs, least)
    groups = groups_of(docs, kept)
    known = with_groups(kept, groups)

    p, q = share_sql("n + 2", "size + 2 * terms"), share_sql("total + 2", "lang_size + 2 * terms")
    over = known.select("lang", "source", F.col("term").alias("item"), F.expr(p).alias("p"), F.expr(q).alias("q")).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    words = over.withColumn("rank", ranked).filter(F.col("rank") <= top)

    entries = known.select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "source", "term", "n")
    spread = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", "size", "terms")
    sums = entries.groupBy("lang", "bucket").cogroup(spread.groupBy("lang", "bucket")).applyInArrow(bucket_pairs, SUMS_DDL)
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", sides.alias("side")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    return pairs.withColumn("rank", ranked).unionByName(words)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same from a table of every group's share of every kept term."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (size + 2 * v) AS p, 1 + ({SCALE}::HUGEINT * (total + 2)) // (l.n + 2 * v) AS q
  FROM sizes JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {"op11_source_divergence": oracle()}

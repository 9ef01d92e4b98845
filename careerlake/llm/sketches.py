"""Document fingerprints by a threshold-scaled sketch.

A text's words are cut into runs of SHINGLE words, each hashed (the first 64 bits of its MD5), and every hash below FRACTION of the range
is retained. So a sketch grows with its text, the same run is retained in every text or in none, and what two sketches share tells how
much of the smaller text stands in the larger, however unequal they are. A text none of whose hashes is below retains its least one, so
that no text with a word has an empty sketch. Sketches of parts merge into that of the whole: the hashes below, or the least of all.

op12 compares each document with the next one by id and with an edited text, its last quarter replaced by the beginning of the next
document. Documents are not sorted as a whole: ids alone are dealt by range, the last of a range meets the first of the following in a
table with a row for each range, and each document sends as much of its beginning as the one before it asks for. Texts are shuffled once,
beginnings once more.

DataFrame functions only. A null text counts as empty; an empty text has fingerprint ''. Likeness of equal sketches is 1, empty ones
included, of an empty one with another 0. Rows with a null id come last in the order. Rows with the same id have the same next document:
of the rows of the next larger id the one whose text has the smallest MD5. The next of the last is the first, of a single document itself.
Repeated rows stay, row for row. Ids and texts however common are dealt out. A very long text takes memory in proportion to its length.
An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerlake.llm.common import dealt_join, table, written

SHINGLE, FRACTION = 5, 1 / 8
SPACE = "[\\x20\\x09-\\x0D]+"
KEY = ["none", "id"]


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def least_not_kept(fraction: float) -> str:
    if not 0 < fraction < 1:
        raise ValueError("fraction: above 0, below 1")
    return format(int(fraction * 2**64), "016x")


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """The retained hashes of a text, as 16 hexadecimal digits each, ascending."""
    end = F.lit(least_not_kept(fraction))

    def hashes(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > SHINGLE, F.sequence(F.lit(1), n - (SHINGLE - 1))).when(n > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, SHINGLE), " ")), 1, 16))

    def retained(all_: Column) -> Column:
        return bound(F.filter(all_, lambda h: h < end), lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(all_) > 0, F.array(F.array_min(all_))).otherwise(low))

    return bound(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda words: bound(hashes(words), retained))


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that stands in the other."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def merged(sketches: DataFrame, by: str, fraction: float = FRACTION) -> DataFrame:
    """by, hash: a row for each retained hash of the texts with the same value of by together; sketches has by and the array `sketch`.

    Hashes are rows, so that no value of by, however large, is one row's or one task's. Values that are null or have no hash are left out.
    """
    each = sketches.filter(F.col(by).isNotNull()).select(by, F.explode("sketch").alias("hash")).distinct()
    low = each.filter(F.col("hash") < least_not_kept(fraction))
    least = each.groupBy(by).agg(F.min("hash").alias("hash")).filter(F.col("hash") >= least_not_kept(fraction))
    return low.unionByName(least)


def containments(left: DataFrame, right: DataFrame, by: str, other: str) -> DataFrame:
    """by, other, shared, contained: of pairs with a hash in common, the share of left's hashes that right has too; both as from merged()."""
    sizes = left.groupBy(by).agg(F.count("*").alias("size"))
    shared = left.join(right, "hash").groupBy(by, other).agg(F.count("*").alias("shared"))
    return shared.join(sizes, by).select(by, other, "shared", (F.col("shared") / F.col("size")).alias("contained"))


def places(rows: DataFrame) -> DataFrame:
    """Each id once: n (its rows), first (MD5 of the text that stands for it), back (key of the id before, and the characters that this asks for)."""
    own = rows.groupBy(*KEY).agg(F.max(F.floor(F.length("text") / 4)).alias("asks"), F.count("*").alias("n"), F.min(F.md5("text")).alias("first"))
    ranged = written(own.repartitionByRange(*KEY).withColumn("range", F.spark_partition_id()))
    this = F.struct(*KEY, "asks")
    # a row for each range, so no more than partitions of a shuffle
    ends = ranged.groupBy("range").agg(F.max(this).alias("end"))
    ends = ends.select("range", F.coalesce(F.lag("end").over(Window.orderBy("range")), F.max("end").over(Window.partitionBy())).alias("end"))
    before = F.lag(this).over(Window.partitionBy("range").orderBy(*KEY))
    return ranged.withColumn("before", before).join(F.broadcast(ends), "range").select(*KEY, "n", "first", F.coalesce("before", "end").alias("back"))


def compared(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text)."""
    id_ = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(id_)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = written(places(rows))
    counts = order.select(*KEY, "n")
    # both joins read one exchange of the texts; Spark would not see that they are the same with a sketch in them, so it is made behind them
    own = F.array_join(sketch(F.col("text"), fraction), ",")
    sent = dealt_join(rows, order.drop("n"), KEY, counts=counts).filter(F.col("first").startswith(F.md5("text")))  # as an equality it would be a join key, and the exchange another
    sent = sent.select(*(F.col(f"back.{k}").alias(k) for k in KEY), F.expr("substring(text, 1, int(back.asks))").alias("head"), own.alias("next"))
    sent = sent.groupBy(*KEY).agg(F.first("head").alias("head"), F.first("next").alias("next"))  # repeated rows of the one that stands for an id
    both = dealt_join(rows, sent, KEY, counts=counts).withColumn("n_chars", F.length("text")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - quarter)"), F.expr("substring(head, 1, quarter)"))
    both = both.select(*KEY, "n_chars", own.alias("own"), "next", edited.alias("edited"))
    both = both.select(*KEY, "n_chars", "own", "next", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), fraction).alias("after"))
    # '' has no hash, but split() makes one piece of it
    of = lambda c: F.filter(F.split(c, ","), lambda h: h != "")
    both = both.withColumns({"own_": of("own"), "next_": of("next")})
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        F.col("own").alias("fingerprint"),
        F.array_join("after", ",").alias("edited_fingerprint"),
        likeness(F.col("own_"), F.col("after")).alias("near_edited"),
        likeness(F.col("own_"), F.col("next_")).alias("near_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """The same from whole texts in the order of ids."""
    end = least_not_kept(FRACTION)
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE))
    like = "CASE WHEN {0} = {1} THEN 1.0::DOUBLE WHEN least(len({0}), len({1})) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / least(len({0}), len({1})) END"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS place, count(*) OVER () AS n, first FROM (SELECT doc_id, arg_min(t, md5(t)) AS first FROM docs GROUP BY doc_id)),
texts AS (SELECT doc_id, t, substr(t, 1, length(t) - length(t) // 4) || substr(b.first, 1, length(t) // 4) AS edited, b.first AS next
  FROM (SELECT docs.doc_id, t, place % n + 1 AS after FROM docs JOIN ids ON docs.doc_id IS NOT DISTINCT FROM ids.doc_id) JOIN (SELECT place, first FROM ids) b ON b.place = after),
all_ AS (SELECT t AS x FROM texts UNION SELECT edited FROM texts),
words AS (SELECT x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w FROM all_),
shingles AS (SELECT x, CASE WHEN len(w) > {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: {run}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
hashes AS (SELECT x, list_sort(list_distinct(list_transform(s, lambda v: left(md5(v), 16)))) AS h FROM shingles),
sketches AS (SELECT x, CASE WHEN len(h) > 0 AND h[1] >= '{end}' THEN h[1:1] ELSE list_filter(h, lambda v: v < '{end}') END AS k FROM hashes)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a.k, ',') AS fingerprint, array_to_string(b.k, ',') AS edited_fingerprint,
  {like.format("a.k", "b.k")} AS near_edited, {like.format("a.k", "c.k")} AS near_next
FROM texts JOIN sketches a ON a.x = t JOIN sketches b ON b.x = edited JOIN sketches c ON c.x = next"""


QUERIES = {"op12_fingerprints": op12_fingerprints}
SQL = {"op12_fingerprints": oracle()}

"""Interactions of five filters by inclusion-exclusion, for all 120 orders they may be applied in.

Of each document it is known which filters it fails. For each of the 32 sets of filters the documents that fail all of the set are
counted, as sums of products of flags; every other figure follows from these 32 numbers. Möbius inversion from below gives the
documents that survive any set, so those that a step keeps and removes in any order; inversion from above gives those that fail a set
and nothing else. The numbers with alternating signs are the Harsanyi dividends of the game "documents removed", and a filter's
Shapley value shares each dividend equally among the filters of its set.

Documents are read once, as a row of flags, a digest and an id each; what is equal to an earlier text is found by digests (SHA-256), in a
join that deals common digests out. Counts are added up in parts, and a part has 600 rows in the result, whatever its size.

A null text counts as empty (it fails A alone, and E after the first empty one), a null lang as ''. A null id is neither smaller nor
larger than any other, so it never fails E, and has no label. Rows with the smallest id of a text all pass E, repeated rows included.
Several labels of an id: one of quality 1 is enough, one of toxic 1 too; null labels count as 0. A very long text takes memory in
proportion to its length. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import dealt_join, table, written

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE = "[\\x20\\x09-\\x0D]+"
#: Fewest words, least percentage of distinct words, most percentage of capitals, signs that may not stand.
WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
#: Parts that rows without an id are dealt to in the join with labels.
SALTS = 1024


def failures(text: Column) -> list[Column]:
    """Whether a text fails A to D."""
    counted = F.transform(F.array(F.filter(F.split(text, SPACE), lambda w: w != "")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return [counted["n"] < WORDS, 100 * counted["distinct"] < DISTINCT * counted["n"], 100 * capitals.cast("long") > CAPITALS * F.length(text), text.rlike(SIGNS)]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (0 or 1, 1: fails), good, toxic (0 or 1) of each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("__text"))
    own = plain.select("doc_id", "part", *(c.cast("int").alias(f) for f, c in zip(FILTERS, failures(F.col("__text")))), F.unhex(F.sha2("__text", 256)).alias("digest"))
    rows = written(own)
    lows = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    copies = dealt_join(rows, lows, ["digest"]).withColumn("E", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)).cast("int"))
    # nulls find no label, but would all be one task's
    salted = copies.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    joined = salted.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    return joined.select("part", *FILTERS, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def joint(rows: DataFrame) -> DataFrame:
    """part, and as arrays over the 32 sets: all, good, toxic documents that fail every filter of the set."""
    cells = rows.groupBy("part", *FILTERS, "good", "toxic").agg(F.count("*").alias("n"))

    def sums(of: Column) -> Column:
        return F.array(*(F.sum(reduce(mul, (F.col(f) for k, f in enumerate(FILTERS) if s >> k & 1), of)) for s in SETS))

    n = F.col("n")
    return cells.groupBy("part").agg(sums(n).alias("all"), sums(n * F.col("good")).alias("good"), sums(n * F.col("toxic")).alias("toxic"))


def bits() -> Column:
    return F.array(*(F.lit(1 << k) for k in range(len(FILTERS))))


def survivors(counts: Column) -> Column:
    """Of each set: the documents that fail none of it."""
    return F.aggregate(bits(), counts, lambda a, bit: F.transform(a, lambda x, i: F.when(i.bitwiseAND(bit) != 0, F.get(a, i - bit) - x).otherwise(x)))


def exactly(counts: Column) -> Column:
    """Of each set: the documents that fail all of it and nothing else."""
    return F.aggregate(bits(), counts, lambda a, bit: F.transform(a, lambda x, i: F.when(i.bitwiseAND(bit) == 0, x - F.get(a, i + bit)).otherwise(x)))


def shares(counts: Column) -> Column:
    """Of each set: what a filter of it gets of its dividend, times the number of orders."""
    each = [0] + [(1 if s.bit_count() % 2 else -1) * len(ORDERS) // s.bit_count() for s in SETS if s]
    return F.zip_with(counts, F.array(*(F.lit(x).cast("long") for x in each)), lambda n, x: n * x)


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part of counts (as of joint()), order and step."""
    inverted = counts.select(
        "part", "all", survivors(F.col("all")).alias("left"), survivors(F.col("good")).alias("good"), survivors(F.col("toxic")).alias("toxic"), exactly(F.col("all")).alias("exactly"), shares(F.col("all")).alias("shares")
    )
    orders = inverted.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("letters", F.split("filter_order", ""))
    steps = (
        orders.select("*", F.posexplode("letters").alias("place", "letter"))
        .withColumn("bit", F.expr("shiftleft(1, ascii(letter) - 65)"))
        .withColumn("before", F.expr("aggregate(slice(letters, 1, place), 0, (a, x) -> a + shiftleft(1, ascii(x) - 65))"))
        .withColumn("after", F.col("before") + F.col("bit"))
    )
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    own = F.aggregate(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(F.col("bit")) != 0, F.get("shares", s)).otherwise(0))
    return steps.select(
        "part",
        "filter_order",
        (F.col("place") + 1).cast("int").alias("step"),
        F.get("left", F.col("after")).alias("kept"),
        lost("left").alias("removed"),
        (F.get("all", F.col("bit")) - lost("left")).alias("redundant"),
        F.get("exactly", F.col("bit")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        own.alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(joint(flagged(docs, labels)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """Every order applied filter by filter to the documents, alike ones together."""
    first = ", ".join(f"CASE WHEN {f} THEN strpos(filter_order, '{f}') ELSE 6 END" for f in FILTERS)
    fails = " || ".join(f"CASE WHEN {f} THEN '{f}' ELSE '' END" for f in FILTERS)
    letters = ", ".join(f"('{f}')" for f in FILTERS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (SELECT part, len(w) < {WORDS} AS A, 100 * len(list_distinct(w)) < {DISTINCT} * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t) AS C,
  regexp_matches(t, '{SIGNS}') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM docs LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, A, B, C, D, E, {fails} AS fails, good, toxic, count(*) AS n FROM flags GROUP BY ALL),
f(x) AS (VALUES {letters}),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
placed AS (SELECT part, filter_order, least({first}) AS first, fails, good, toxic, n FROM cells, orders),
steps AS (SELECT *, substr(filter_order, step, 1) AS f FROM placed, (SELECT unnest(range(1, 6)) AS step)),
sums AS (SELECT part, filter_order, step, f, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN first < step AND contains(fails, f) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN first = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN first = step AND toxic THEN n ELSE 0 END) AS toxic_lost FROM steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums"""


QUERIES = {"op13_filter_audit": op13_filter_audit}
SQL = {"op13_filter_audit": oracle()}

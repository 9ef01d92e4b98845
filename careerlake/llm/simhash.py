"""Near-duplicates by SimHash and a binary trie joined with itself.

Fingerprints within BUDGET differing bits agree in one of three blocks of 21 bits. For each block a trie over the fingerprints,
turned so that this block stands first, is joined with itself: node pairs start equal below the block, descend together and are
dropped once they differ in more than BUDGET bits; pairs with few leaves compare these. A node has at most 2 ** STEP children, so no
group of rows is gathered anywhere, however many fingerprints share a block. Linked fingerprints meet in components by alternating
star contractions. Rows meet fingerprints, and fingerprints the roots of their components, in joins that deal common keys out.

A null text counts as empty (fingerprint 0, linked like any other). Null ids don't count for the smallest id of a component; where all
are null, component_id is null. Repeated rows stay, row for row. A bit set in exactly half the hashes is 0. A very long text is hashed
whole, in memory in proportion to its length. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerlake.llm.common import by_text, cut, dealt_join, table

SHINGLE, SEED, BUDGET = 3, 42, 2
BLOCK, STEP = 21, 6
#: Node pairs with at most this many leaf pairs compare them at once.
FEW = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = pa.schema([("fp", pa.int64())])


def fingerprints(texts: list[str]) -> list[tuple[int]]:
    """Signed 64-bit fingerprints: a bit is 1 if set in over half the shingles' hashes."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes, sizes = [], []
    for t in texts:
        words = t.encode().translate(LOWER).split()
        shingles = zip(*(words[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [words] if words else []
        hashes.append(list(map(digest, map(b" ".join, shingles))))
        sizes.append(len(hashes[-1]))
    every, n = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64), np.array(sizes, np.int64)
    full = np.flatnonzero(n)
    out = np.zeros(len(texts), np.uint64)
    if len(full):
        first = (np.cumsum(n) - n)[full]
        for b in range(64):
            ones = np.add.reduceat((every >> np.uint64(b) & np.uint64(1)).astype(np.int64), first)
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(b)
    return [(x,) for x in out.view(np.int64).tolist()]


def with_fingerprint(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return by_text(docs, SCHEMA, "fp long", fingerprints, keep)


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def turned(fp: Column, block: int) -> Column:
    """The fingerprint with a block's bits first."""
    left = BLOCK * block
    return fp if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def trie_self_join(fps: DataFrame) -> DataFrame:
    """Pairs x, y of different fingerprints in the column fp (each once) within BUDGET bits; each pair once."""
    leaves = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), turned(F.col("fp"), k).alias("leaf")) for k in range(3)))).alias("e")).select("e.*")

    def nodes(depth: int) -> DataFrame:
        return leaves.groupBy("k", F.shiftrightunsigned("leaf", 64 - depth).alias("node")).agg(F.count("*").alias("n"))

    def at(side: str, depth: int) -> DataFrame:
        return leaves.select(F.col("k"), F.shiftrightunsigned("leaf", 64 - depth).alias(side), F.col("leaf").alias(f"{side}_leaf"))

    def below(side: str, depth: int, step: int) -> DataFrame:
        return nodes(depth + step).select(F.col("k"), F.shiftrightunsigned("node", step).alias(side), F.col("node").alias(f"{side}_next"), F.col("n").alias(f"n{side}_next"))

    depth, found = BLOCK, []
    pairs = cut(nodes(depth).filter("n > 1").select("k", F.col("node").alias("a"), F.col("node").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb")))
    while not pairs.isEmpty():
        few = pairs.filter((F.col("na") * F.col("nb") <= FEW) | F.lit(depth >= 64)).select("k", "a", "b")
        here = few.join(at("a", depth), ["k", "a"]).join(at("b", depth), ["k", "b"])
        found.append(here.filter((differing("a_leaf", "b_leaf") <= BUDGET) & ((F.col("a") < F.col("b")) | (F.col("a_leaf") < F.col("b_leaf")))).select("k", "a_leaf", "b_leaf"))
        if depth >= 64:
            break
        step = min(STEP, 64 - depth)
        many = pairs.filter(F.col("na") * F.col("nb") > FEW)
        both = many.select("k", "a", "b").join(below("a", depth, step), ["k", "a"]).join(below("b", depth, step), ["k", "b"])
        alive = (differing("a_next", "b_next") <= BUDGET) & ((F.col("a") < F.col("b")) | (F.col("a_next") <= F.col("b_next")))
        one = (F.col("a_next") == F.col("b_next")) & (F.col("na_next") < 2)
        depth += step
        pairs = cut(both.filter(alive & ~one).select("k", F.col("a_next").alias("a"), F.col("b_next").alias("b"), F.col("na_next").alias("na"), F.col("nb_next").alias("nb")))
    if not found:
        return fps.sparkSession.createDataFrame([], "x long, y long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    back = lambda c: F.when(F.col("k") == 0, F.col(c)).when(F.col("k") == 1, turned_back(F.col(c), 1)).otherwise(turned_back(F.col(c), 2))
    out = every.select("k", back("a_leaf").alias("x"), back("b_leaf").alias("y"))
    equal = lambda k: F.shiftrightunsigned(turned(F.col("x"), k), 64 - BLOCK) == F.shiftrightunsigned(turned(F.col("y"), k), 64 - BLOCK)
    earlier = ((F.col("k") > 0) & equal(0)) | ((F.col("k") > 1) & equal(1))  # an earlier trie has it
    return out.filter(~earlier).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def turned_back(fp: Column, block: int) -> Column:
    left = BLOCK * block
    return F.shiftrightunsigned(fp, left).bitwiseOR(F.shiftleft(fp, 64 - left))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of links (x, y), by alternating large and small stars."""

    def star(edges: DataFrame, small: bool) -> DataFrame:
        way = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        if not small:
            way = way.unionByName(way.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = way.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        near = dealt_join(way, least, ["u"])
        out = near.filter((F.col("v") > F.col("u")) if not small else (F.col("v") != F.col("m"))).select(F.col("v").alias("x"), F.col("m").alias("y"))
        if small:
            out = out.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        return out.filter("x != y").distinct()

    edges, before = cut(links.select("x", "y").distinct()), None
    while True:
        print_ = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(greatest(x, y), least(x, y)))")).first()
        if print_ == before or not print_[0]:
            break
        before = print_
        edges = cut(star(cut(star(edges, False)), True))
    leaf = edges.select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("root"))
    return leaf.unionByName(leaf.select(F.col("root").alias("node"), "root").distinct())


def classes(nodes: DataFrame) -> DataFrame:
    """fp, n, root (its component's smallest fingerprint), component_id of each of nodes: fp, n (its rows), low (its smallest id)."""
    roots = components(trie_self_join(nodes.select("fp")))
    own = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    low = own.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    return cut(dealt_join(own.withColumnRenamed("n", "rows"), low, ["root"]).select("fp", F.col("rows").alias("n"), "root", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    members = cut(with_fingerprint(docs))
    nodes = cut(members.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    out = dealt_join(members, classes(nodes).drop("root"), ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, of rows with this id and several texts or repeated ones one; rows without an id come last.

    docs may have any columns besides doc_id and text, whatever their names.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    members = with_fingerprint(marked, ("doc_id", "text_hash"))
    nodes = cut(members.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("low"), F.count("*").alias("n")))
    first = classes(nodes).groupBy("root").agg(F.first("component_id").alias("r"))  # the same on all rows of a component
    first = first.select(F.col("r.doc_id").alias("first_id"), F.col("r.text_hash").alias("first_hash"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit(0)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), order.alias("order"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["first_id"]) & (rows["hash"] == first["first_hash"]), "left_semi")
    numbered = kept.withColumn("number", F.row_number().over(Window.partitionBy("id", "hash").orderBy("order")))
    return numbered.filter("number = 1").select("row.*")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
SQL: dict[str, str] = {}

"""Skills of a taxonomy that is a table, of any size: labels are joined with the words of texts, not written into the plan.

A label stands in a text where neither a letter a-z nor a digit touches it, as in match.skills_in(). Its key is the rarest of its pairs of
runs of a-z and 0-9, with what stands between them, or of its runs and other characters where it has no pair. So a block of a text is compared
with few labels: those whose key it has.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.functions.text import squeezed
from careerlake.sources.tables import ship, stored

#: Characters of a text that are searched at a time; a block of a longer label is as long as that.
BLOCK = 4096
#: Bytes of labels that are broadcast at a time; more labels than that are looked for in several passes over the texts.
SLICE = 32 << 20

_RUN = "(?<![a-z0-9])[a-z0-9]++"
#: Runs at the very ends of a block may be cut, so only what has something on both sides counts.
_INNER = "(?<=[^a-z0-9])[a-z0-9]++(?=[^a-z0-9])"
_PAIR = "(?<=[^a-z0-9])(?=([a-z0-9]++[^a-z0-9]++[a-z0-9]++)[^a-z0-9])"
_MARKED = "\u0001$0\u0002"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_INNER}|[^a-z0-9 ]"), F.lit(0))


def pairs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1))


_PARTS, _RUNS = re.compile("[a-z0-9]+|[^a-z0-9]+"), re.compile("[a-z0-9]+")


def keys_in(text: str, known: frozenset[str]) -> set[str]:
    """Of the known keys those that a text has among its tokens() and pairs()."""
    parts = _PARTS.findall(text)
    # parts are by turns runs and what stands between; a run at the very start or end doesn't count
    at = 2 if parts and _RUNS.match(text) else 1
    runs, between = parts[at:-1:2], parts[at + 1 : -1 : 2]
    others = set("".join(set(parts[at - 1 :: 2]))) - {" "}
    return known.intersection(runs) | known.intersection(map("".join, zip(runs, between, runs[1:]))) | known.intersection(others)


def keys_found(piece: Column, known: Broadcast) -> Column:
    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        keys = known.value
        return pa.array([sorted(keys_in(t, keys)) for t in texts.to_pylist()], pa.list_(pa.string()))

    # else Spark runs it twice, once for a filter of its own by the keys' number
    return found.asNondeterministic()(piece)


def variants(taxonomy: DataFrame) -> DataFrame:
    """variant, canonical, category, match_type, place of (canonical, category, synonyms).

    Names and synonyms are read without case, with single blanks; blank ones go. The name comes first, then synonyms as listed; a synonym
    equal to the name counts as synonym. A variant of several skills is the one's with the greatest name.
    """
    other = F.coalesce("synonyms", F.array().cast("array<string>"))
    listed = taxonomy.select("canonical", "category", F.transform(other, lambda s: squeezed(s)).alias("others"))
    each = listed.select("*", F.posexplode(F.concat(F.array(squeezed("canonical")), "others")).alias("place", "variant")).filter("variant != ''")
    kind = F.when(F.array_contains("others", F.col("variant")), "synonym").otherwise("exact")
    best = F.max(F.struct("canonical", (-F.col("place")).alias("place"), "category", kind.alias("match_type"))).alias("b")
    return each.groupBy("variant").agg(best).select("variant", "b.canonical", "b.category", "b.match_type", (-F.col("b.place")).alias("place"))


def keyed(listed: DataFrame) -> DataFrame:
    """Variants with their key: the pair, or token where there is none, that fewest variants have, then the longest, then the smallest."""
    whole = F.concat(F.lit(" "), "variant", F.lit(" "))
    each = listed.select("variant", F.explode(F.array_distinct(F.when(F.size(pairs(whole)) > 0, pairs(whole)).otherwise(tokens(whole)))).alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    key = each.join(common, "token").groupBy("variant").agg(F.min_by("token", F.struct("n", (-F.length("token")).alias("l"), "token")).alias("key"))
    return listed.join(key, "variant")


def blocks(text: Column, size: int, longest: int) -> Column:
    """A text in pieces, each with the end of the one before, so that a label of at most `longest` characters is whole in one, with its neighbours."""
    cut = F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    with_end = lambda parts: F.transform(parts, lambda b, i: F.concat(F.when(i > 0, F.substring(F.get(parts, i - 1), -(longest + 1), longest + 1)).otherwise(""), b))
    return F.transform(F.array(cut), with_end)[0]


def skills(docs: DataFrame, taxonomy: DataFrame, block: int = BLOCK, at_once: int = SLICE) -> DataFrame:
    """doc_id, canonical, category, variant, match_type: a row for each skill of the taxonomy with a variant in a text, with the first of its variants.

    `docs` has doc_id and text; a null or empty text has no skills; rows with one id, or none, count as one document. An empty taxonomy
    gives no rows. Texts aren't shuffled: labels, and their keys, are broadcast, at most `at_once` bytes of them in a pass; what is shuffled are ids and labels found.
    """
    known = stored(keyed(variants(taxonomy)))
    n_bytes = F.sum(F.octet_length("variant") * 2 + F.octet_length("canonical") + F.octet_length(F.coalesce("category", F.lit(""))) + 64)
    size, longest = known.agg(n_bytes, F.max(F.length("variant"))).first()
    passes, longest = -(-(size or 1) // at_once), longest or 0
    edged = F.col("variant").rlike("^[^a-z0-9]|[^a-z0-9]$")
    whole = F.concat(F.lit("(?<=[^a-z0-9])"), F.regexp_replace("variant", "[^a-z0-9 ]", r"\\$0"), F.lit("(?=[^a-z0-9])"))
    labels = known.withColumns({"alone": (F.col("variant") == F.col("key")) & ~edged, "edged": edged, "marked": F.regexp_replace("variant", _RUN, _MARKED), "pattern": F.when(edged, whole)})

    spark = ship(docs.sparkSession)
    pieces = docs.select("doc_id", F.explode(blocks(squeezed("text"), max(block, longest + 2), longest)).alias("piece"))
    stands = F.col("alone") | (F.contains("told", "marked") & (~F.col("edged") | F.expr("piece RLIKE pattern")))
    found = []
    for k in range(passes):
        now = labels.filter(F.pmod(F.xxhash64("variant"), F.lit(passes)) == k)
        # a small Python task keeps the keys of labels, as few of a text's tokens and pairs are; only these become rows
        known_keys = spark.sparkContext.broadcast(frozenset(r["key"] for r in now.select("key").distinct().collect()))
        having = pieces.withColumn("keys", keys_found(F.col("piece"), known_keys))
        told = having.select("doc_id", "piece", F.when(F.size("keys") > 0, F.regexp_replace("piece", _INNER, _MARKED)).alias("told"), "keys")
        each = told.select("doc_id", "piece", "told", F.explode("keys").alias("key"))
        found.append(each.join(F.broadcast(now), "key").filter(stands).select("doc_id", "canonical", "place", "category", "variant", "match_type"))
    first = reduce(DataFrame.unionByName, found).groupBy("doc_id", "canonical").agg(F.min(F.struct("place", "variant", "category", "match_type")).alias("f"))
    return first.select("doc_id", "canonical", "f.category", "f.variant", "f.match_type")

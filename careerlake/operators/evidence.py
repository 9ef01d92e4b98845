"""Which skills a user's own repositories show: a skill stands somewhere in language, name, description and topics, whatever the case.

Skills are a table of any size. They are found by posting lists of their runs of three characters, not by comparing each with each row: a
skill's key is the one of its runs that fewest rows have, a row is compared with the skills whose key it has, and then exactly. Skills
of fewer characters are their own key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.sources.tables import stored

#: Characters of a key; bytes of skills that are broadcast at a time (more are looked for in several passes); names listed of a skill.
RUN, SLICE, NAMES = 3, 32 << 20, 4


def said(*parts: Column) -> Column:
    """What a row says: parts that aren't null or empty, with single blanks between, in lower case."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.lower(F.array_join(kept, " "))


def runs(text: Column, lengths: list[int]) -> Column:
    """Different runs of characters of a text that have one of the lengths, 0 to RUN; in time linear in the text."""

    def of(chars: Column, n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        each = F.transform(chars, lambda c, i: F.array_join(F.slice(chars, i + 1, n), ""))
        return F.filter(each, lambda r: F.length(r) == n)

    # bound to a variable, else the text would be split anew for each run
    return F.transform(F.array(F.split(text, "")), lambda chars: F.array_distinct(F.concat(*(of(chars, n) for n in lengths))))[0]


def found_in(rows: DataFrame, skills: DataFrame, at_once: int = SLICE) -> DataFrame:
    """id, place, skill: each skill of `skills` (skill) in each of `rows` (id, place, said) that has it; rows aren't shuffled.

    A null skill is in no row, an empty one in all. Skills that differ in case alone are looked for each. Repeated skills count once,
    repeated rows each. Empty tables give no rows.
    """
    wanted = skills.filter("skill IS NOT NULL").select("skill").distinct().withColumn("low", F.lower("skill"))
    lengths = sorted(r[0] for r in wanted.select(F.least(F.length("low"), F.lit(RUN))).distinct().collect())  # 0 to RUN
    own = F.filter(runs(F.col("low"), lengths or [RUN]), lambda r: F.length(r) == F.least(F.length("low"), F.lit(RUN)))
    keys = wanted.select("skill", "low", F.explode(own).alias("run"))
    each = rows.select("id", "place", "said", F.explode(runs(F.col("said"), lengths or [RUN])).alias("run"))
    common = each.join(keys.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    # a run that no row has is the best of keys: its skill is in none
    key = F.min_by("run", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("run")
    known = stored(keys.join(common, "run", "left").groupBy("skill", "low").agg(key))
    size = known.agg(F.sum(F.octet_length("skill") + F.octet_length("low") + 64)).first()[0] or 1
    passes = -(-size // at_once)
    parts = [each.join(F.broadcast(known.filter(F.pmod(F.xxhash64("skill"), F.lit(passes)) == k)), "run") for k in range(passes)]
    return reduce(DataFrame.unionByName, parts).filter(F.contains("said", "low")).select("id", "place", "skill")


def evidence(rows: DataFrame, skills: DataFrame, names: int = NAMES, at_once: int = SLICE) -> DataFrame:
    """skill, names: of each different skill, null ones aside, the ids of the first rows by place, then id, that show it; none where no row does."""
    first = Window.partitionBy("skill").orderBy("place", "id")
    top = found_in(rows, skills, at_once).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= names)
    listed = top.groupBy("skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("names"))  # `names` at most
    everything = skills.filter("skill IS NOT NULL").select("skill").distinct()
    return everything.join(listed, "skill", "left").select("skill", F.coalesce("names", F.array().cast(listed.schema["names"].dataType)).alias("names"))


def languages(rows: DataFrame, language: str) -> DataFrame:
    """language, n of the rows that have one."""
    return rows.filter(F.col(language) != "").groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n"))

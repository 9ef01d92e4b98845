"""Stores of reports and users: lookups, policies, constraints, triggers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none if missing."""
    return df.filter(F.col(key) == value)


def recent(df: DataFrame, at: str, key: str, n: int = 50) -> DataFrame:
    """The n newest rows; equal times by key. Planned as a top-k without a full sort."""
    return df.orderBy(F.desc(at), F.col(key)).limit(n)


def mean_rate(df: DataFrame, rate: str, where: Column | None = None) -> DataFrame:
    """n and mean to three places; null without rows."""
    rows = df.filter(where) if where is not None else df
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(rate), 3).alias("mean_rate"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def scoped(df: DataFrame, owner: str, user) -> DataFrame:
    """What a user may see of their own; a null owner is nobody's."""
    return df.filter(F.col(owner) == user)


def either_party(df: DataFrame, a: str, b: str, user) -> DataFrame:
    return df.filter((F.col(a) == user) | (F.col(b) == user))


def allowed(rows: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for which a profile with the same keys exists."""
    return rows.join(profiles, keys, "left_semi")


def top_per_group(df: DataFrame, group: list[str], by: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quarantine(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with `broken`: names of the checks that a row fails; a check of null is not failed."""
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in checks.items())))
    return df.withColumn("broken", F.array_join(failed, ","))


def once_a_day(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key and day: the first."""
    day = F.to_date(at).alias("day")
    return events.groupBy(*keys, day).agg(F.min(at).alias("first_at"), F.count("*").alias("n"))


def latest(df: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest row of each key; later tie wins."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("r")).select(key, "r.*")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascading delete."""
    return df.join(gone.select(key), key, "left_anti")


def invite_code(key: Column) -> Column:
    return F.upper(F.substring(F.md5(key.cast("string")), 1, 6))


def display_name(meta: Column, email: Column) -> Column:
    """The name in a JSON object, else what stands before the @."""
    return F.coalesce(F.get_json_object(meta, "$.display_name"), F.split_part(email, F.lit("@"), F.lit(1)))


def touched(before: DataFrame, changes: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows with the values of their change, if any, and then `updated_at`; changes has a row for a key at most."""
    columns = [c for c in before.columns if c not in (key, "updated_at")]
    new = changes.select(F.col(key), F.struct(*(F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in columns)).alias("__new"), F.lit(True).alias("__changed"))
    out = before.join(new, key, "left")
    stamped = F.when(F.col("__changed"), at).otherwise(F.col("updated_at"))
    return out.select(key, *(F.coalesce(F.col("__new")[c], F.col(c)).alias(c) for c in columns), stamped.alias("updated_at"))

"""Activity, streaks, calendars and labels; days are UTC and today is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.functions.text import percent


def days(events: DataFrame, user: str = "user_id", at: str = "ts") -> DataFrame:
    return events.select(user, F.to_date(at).alias("day")).distinct()


def islands(active: DataFrame, user: str = "user_id") -> DataFrame:
    """Runs of days without a gap: user, first, last, length."""
    n = F.row_number().over(Window.partitionBy(user).orderBy("day"))
    runs = active.withColumn("run", F.date_sub("day", n)).groupBy(user, "run")
    return runs.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("run")


def current_streak(active: DataFrame, as_of: Column, user: str = "user_id") -> DataFrame:
    """Length of the run that ends today or yesterday, else 0; days after today don't count."""
    runs = islands(active.filter(F.col("day") <= as_of), user)
    live = F.when(F.datediff(as_of, "last_day") <= 1, F.col("length")).otherwise(0)
    return runs.groupBy(user).agg(F.max(live).cast("long").alias("streak"), F.max("length").alias("longest"), F.max("last_day").alias("last_day"))


def streak_states(active: DataFrame, user: str = "user_id", longest_on_first: bool = True) -> DataFrame:
    """The state after each day: streak, longest, action, milestone. Without longest_on_first, a first day or a reset doesn't count for longest."""
    w = Window.partitionBy(user).orderBy("day")
    before = F.datediff("day", F.lag("day").over(w))
    out = active.withColumn("gap", before).withColumn("run", F.sum(F.when(F.col("gap") == 1, 0).otherwise(1)).over(w))
    out = out.withColumn("streak", F.row_number().over(Window.partitionBy(user, "run").orderBy("day")).cast("long"))
    counted = F.col("streak") if longest_on_first else F.when(F.col("streak") > 1, F.col("streak")).otherwise(0)
    out = out.withColumn("longest", F.max(counted).over(w).cast("long"))
    action = F.when(F.col("gap") > 1, "reset").otherwise("incremented")
    return out.select(user, "day", "streak", "longest", action.alias("action"), F.when(F.col("streak").isin(3, 7, 30), F.col("streak")).alias("milestone"))


def calendar(active: DataFrame, as_of: Column, n: int = 30, user: str = "user_id") -> DataFrame:
    """Each of the last n days of each user, and whether it was active."""
    users = active.select(user).distinct()
    every = users.select(user, F.explode(F.sequence(F.date_sub(as_of, n - 1), as_of)).alias("day"))
    return every.join(active.withColumn("active", F.lit(True)), [user, "day"], "left").fillna(False, ["active"])


def last_week(streak: Column, last: Column, as_of: Column) -> Column:
    """Seven flags, oldest first, of the days that a streak covers."""
    return F.transform(F.sequence(F.date_sub(as_of, 6), as_of), lambda d: (d <= last) & (F.datediff(last, d) < streak))


def age_label(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    hours, whole_days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(whole_days.cast("string"), F.lit("d ago")))
    )


def issue(day: Column) -> dict[str, Column]:
    """Number of the monthly issue since January 2025, its season and month."""
    year, month = F.year(day), F.month(day)
    season = F.when(month.isin(12, 1, 2), "Winter").when(month <= 5, "Spring").when(month <= 8, "Summer").otherwise("Fall")
    return {
        "issue_number": F.greatest(F.lit(1), (year - 2025) * 12 + month).cast("long"),
        "season_year": F.concat(season, F.lit(" ’"), F.substring(year.cast("string"), 3, 2)),
        "month_year": F.concat(F.upper(F.date_format(day, "MMM")), F.lit("."), year.cast("string")),
        "quarter": F.quarter(day).cast("long"),
    }


def pseudonym(user: Column, college: Column) -> Column:
    """An animal by a rolling hash of the id, and the first word of the college."""
    codes = F.transform(F.filter(F.split(user, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(4294967296)))
    animal = F.get(F.array(*(F.lit(a) for a in dims.ANIMALS)), F.pmod(h, F.lit(len(dims.ANIMALS))).cast("int"))
    short = F.substring(F.get(F.split(F.coalesce(college, F.lit("")), r"\s|,|\("), F.lit(0)), 1, 8)
    return F.concat(animal, F.lit(" from "), F.when(short == "", "Anon").otherwise(short))


def progress(tasks: DataFrame, group: str, done: Column) -> DataFrame:
    return tasks.groupBy(group).agg(F.count_if(done).alias("done"), F.count("*").alias("total")).withColumn("pct", percent(F.col("done"), F.col("total")))


def live_dates(at: Column) -> dict[str, Column]:
    """A moment as a long date, a short date and a date with time, the day before the month."""
    return {"long": F.date_format(at, "EEEE, d MMMM yyyy"), "short": F.date_format(at, "dd MMM yyyy"), "timed": F.date_format(at, "EEE, d MMM yyyy, hh:mm a")}


def standing(rows: DataFrame, group: str, value: str, parts: int = 1000) -> DataFrame:
    """rows with n (rows of the group), below (those of the group with a smaller value), low and high of the group.

    A group's values are cut into parts between low and high: ranks are made within a part, and what stands in the parts before is added,
    so that a group with many rows isn't one task's.
    """
    spans = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(parts - 1), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * parts))).otherwise(0)
    dealt = rows.join(spans, group).withColumn("__part", at.cast("int"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n")).select(group, "__part", before.alias("__before"))
    rank = F.rank().over(Window.partitionBy(group, "__part").orderBy(value)) - 1
    return dealt.withColumn("__rank", rank).join(sizes, [group, "__part"]).withColumn("below", F.col("__rank") + F.col("__before")).drop("__part", "__rank", "__before")

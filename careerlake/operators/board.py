"""Job boards: filters, sorts, matches, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.functions.text import any_of, half_up, percent, strings


def faceted(jobs: DataFrame, city: str | None = None, domain: str | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """City Remote means the type; other cities and domains match as parts of names, in any case."""
    out = jobs
    if city and city != "All Cities":
        out = out.filter(F.col("type") == "Remote") if city == "Remote" else out.filter(F.contains(F.lower("city"), F.lit(city.lower())))
    if domain and domain != "All Domains":
        out = out.filter(F.contains(F.lower("domain"), F.lit(domain.lower())))
    return out.filter(F.col("type").isin(*types)) if types else out


def mentions(query: str, *names: str) -> Column:
    """Any of the strings, or an item of an array named `skills`, contains the query."""
    q = F.lit(query.lower())
    return any_of([*(F.contains(F.lower(n), q) for n in names), F.exists("skills", lambda s: F.contains(F.lower(s), q))])


def pay_rank(pay: Column) -> Column:
    """All digits as one number, 0 without any: "14-18" counts as 1418."""
    return F.coalesce(F.regexp_replace(pay, r"\D", "").try_cast("long"), F.lit(0).cast("long"))


def fit(skills: Column, keywords: Column) -> Column:
    """Share of a job's skills that contain a keyword or are contained in one; null without keywords or skills."""
    hit = F.filter(skills, lambda s: F.exists(keywords, lambda k: F.contains(k, F.lower(s)) | F.contains(F.lower(s), k)))
    return F.when((F.size(keywords) > 0) & (F.size(skills) > 0), half_up(100.0 * F.size(hit) / F.size(skills)))


def listing(title: Column, place: Column, low: Column, high: Column) -> dict[str, Column]:
    """Role, city, type and pay of a raw posting."""
    lower = F.lower(title)
    lakhs = lambda x: half_up(x / 100000).cast("string")
    return {
        "role": F.regexp_replace(title, "<[^>]*>?", ""),
        "city": F.split_part(place, F.lit(","), F.lit(1)),
        "type": F.when(F.contains(lower, F.lit("intern")), "Internship").when(F.contains(lower, F.lit("remote")), "Remote").otherwise("Full-Time"),
        "pay": F.when(F.coalesce(low, F.lit(0.0)) == 0, "Competitive").otherwise(F.concat(F.lit("₹"), lakhs(low), F.lit("–"), lakhs(F.coalesce(F.nullif(high, F.lit(0.0)), low * 1.3)), F.lit(" LPA"))),
    }


def city_code(city: Column) -> Column:
    """The known code, else three letters of the name."""
    known = F.create_map(*(F.lit(x) for pair in dims.CITY_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, city), F.upper(F.substring(city, 1, 3)))


def deadline(posted: Column, row: Column, offsets: tuple[int, ...] = (5, 7, 10, 12, 15, 18, 20, 21, 25, 30)) -> Column:
    days = F.coalesce(F.get(F.array(*(F.lit(x) for x in offsets)), row.cast("int")), F.lit(14))
    return F.date_add(posted, days)


def ring_role(role: Column) -> Column:
    """Which skills a role asks for; "ai" and "ml" count anywhere in the name."""
    t = F.lower(F.coalesce(role, F.lit("")))
    has = lambda *parts: any_of(F.contains(t, F.lit(p)) for p in parts)
    return F.when(has("ai", "ml"), "ai").when(has("data"), "data").when(has("cloud", "devops"), "cloud").otherwise("sde")


def ring(role: Column, have: Column) -> Column:
    """acquired, pct, band of the skills that a role asks for."""
    needed = F.element_at(F.create_map(*(x for k, v in dims.RING_SKILLS.items() for x in (F.lit(k), strings(v)))), ring_role(role))
    lower = F.transform(have, lambda k: F.lower(k))
    got = F.filter(needed, lambda s: F.array_contains(lower, F.lower(s)))
    pct = percent(F.size(got), F.size(needed))
    return F.struct(F.size(got).cast("long").alias("acquired"), pct.alias("pct"), F.when(pct >= 75, "success").when(pct >= 50, "warning").otherwise("destructive").alias("band"))


def intensity(jobs: DataFrame, value: str) -> DataFrame:
    """Share of the peak; the peak is one number, so each row gets it by broadcast instead of going to one task."""
    peak = jobs.agg(F.max(value).alias("peak"), F.sum(value).alias("total"))
    out = jobs.crossJoin(F.broadcast(peak))
    return out.withColumn("pct", percent(F.col(value), F.col("peak"))).withColumn("hot", F.col("pct") > 85)


def status(kind: Column) -> Column:
    """Label of a posting by its type."""
    return F.when(kind == "Internship", "internship").when(kind == "Remote", "remote").otherwise("open")


def ticker(jobs: DataFrame, order: list[Column], n: int = 8) -> DataFrame:
    """Code, label and pay of the first n postings."""
    return jobs.orderBy(*order).limit(n).select("id", F.upper(F.substring("city", 1, 3)).alias("code"), F.concat_ws(" · ", "company", "role").alias("label"), F.col("pay").alias("info"))


def any_pill(active: tuple[str, ...], skills: str = "skills", role: str = "role") -> Column:
    """Any of the active skills is part of a skill or of the role, in any case; all pass where none is active."""
    if not active:
        return F.lit(True)
    wanted = strings([a.lower() for a in active])
    return F.exists(wanted, lambda a: F.contains(F.lower(role), a) | F.exists(skills, lambda s: F.contains(F.lower(s), a)))


def or_default(value: Column, default: Column) -> Column:
    """The value, or the default where it is null, zero or empty."""
    return F.when(value.isNull() | (value.cast("string").isin("", "0", "0.0")), default).otherwise(value)


def hour_block(raw: Column) -> Column:
    """The whole number that a text begins with, 0 without one."""
    return F.coalesce(F.regexp_extract(raw, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def job_match(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """Skills of asked (job_id, have) beside those of the job of that id: matched and missing; ids that no job has give nothing."""
    out = asked.join(jobs.select(F.col("id").alias("job_id"), "role", "company", "skills"), "job_id")
    low = F.transform("have", lambda s: F.lower(s))
    return out.select("job_id", "role", "company", F.filter("skills", lambda s: F.array_contains(low, F.lower(s))).alias("matched"), F.filter("skills", lambda s: ~F.array_contains(low, F.lower(s))).alias("missing"))


#: Room above and below the line, in units of the values.
PADDING = 5


def demand_points(today: Column, next_: Column, second: Column, third: Column) -> Column:
    """Six numbers of a demand: today, soon after (5 % more), the next year, half way to the second, the second and the third."""
    return F.array(*(c.cast("double") for c in (today, half_up(1.05 * today), next_, half_up((next_ + second) / 2), second, third)))


def line_points(values: Column, width: int = 120, height: int = 36) -> Column:
    """Values as x,y points with one decimal from left to right, the largest on top, PADDING above and below."""
    low, high, n = F.array_min(values) - PADDING, F.array_max(values) + PADDING, F.size(values)
    tenth = lambda c: F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)
    x = lambda i: F.when(n > 1, width * i / (n - 1)).otherwise(0.0)
    return F.array_join(F.transform(values, lambda v, i: F.concat(tenth(x(i)), F.lit(","), tenth(height - height * (v - low) / (high - low)))), " ")

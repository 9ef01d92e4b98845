"""Sections, experience entries, dates, seniority: state machines over ordered lines as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.conf import DEFAULT, Conf
from careerlake.functions import dims
from careerlake.functions.text import bound, few_words, first_match, one_of, strings, stripped

#: Months since year 0 of an end that is still open.
OPEN = 9999 * 12


def normal_heading(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(line)), r"[^\p{L}\p{N}_\s&]", ""), r"\s+", " ")


#: Letters and digits of known headings, and the least and most that one has; a line with others isn't worth normalising.
LETTERS = sorted({"".join(c for c in w if c.isalnum()) for all_ in dims.SECTIONS.values() for w in all_})
LEAST_LETTERS, MOST_LETTERS = min(map(len, LETTERS)), max(map(len, LETTERS))


def heading_of(line: Column) -> Column:
    """Section that a heading stands for; null of other lines."""
    known = F.expr("map(" + ", ".join(f"'{w}', '{name}'" for name, all_ in dims.SECTIONS.items() for w in all_) + ")")
    has = lambda x, n: x.rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{n}}}")
    # the beginning tells of most lines, so that long ones aren't read to their ends
    start = F.substring(line, 1, 4 * MOST_LETTERS)
    longer = has(start, MOST_LETTERS + 1) | ((F.length(line) > 4 * MOST_LETTERS) & has(line, MOST_LETTERS + 1))
    may_be = F.lower(F.regexp_replace(line, r"[^\p{L}\p{N}]+", "")).isin(*LETTERS)
    return F.when(~longer & has(line, LEAST_LETTERS) & may_be, F.try_element_at(known, normal_heading(line)))


def header_shaped(line: Column) -> Column:
    """One to five words, all in capitals or each beginning with one."""
    s = stripped(line)
    upper = (F.upper(s) == s) & (F.lower(s) != s)
    title = s.rlike(r"\p{L}") & ~s.rlike(r"(^|[^\p{L}])\p{Ll}") & ~s.rlike(r"\p{L}\p{Lu}")
    return few_words(line, 5) & (upper | title)


def sections(of_lines: DataFrame) -> DataFrame:
    """Lines with section_no, canonical_name and via; headings are used up.

    After the first line the state is never empty: a dictionary heading opens a section, every other line belongs to the open one.
    A first line that isn't in the dictionary opens "other", and is used up, if it looks like a header, else "header_block".
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    name = heading_of(F.col("line"))
    first = F.col("line_no") == 0
    opens = F.when(name.isNotNull(), name).when(first & header_shaped(F.col("line")), "other").when(first, "header_block")
    out = of_lines.withColumn("opens", opens).withColumn("dictionary", name.isNotNull())
    out = out.withColumn("section_no", F.count("opens").over(w))
    out = out.withColumns({"canonical_name": F.last("opens", ignorenulls=True).over(w), "via": F.last(F.when(F.col("opens").isNotNull(), F.when(F.col("dictionary"), "dictionary").otherwise("positional_heuristic")), ignorenulls=True).over(w)})
    used_up = F.col("opens").isNotNull() & (F.col("opens") != "header_block")
    return out.filter(~used_up).select("doc_id", "line_no", "line", "section_no", "canonical_name", "via")


def section_order(of_sections: DataFrame) -> DataFrame:
    """Adjacent expected sections, by first place, that stand the wrong way round."""
    rank = F.array_position(strings(dims.EXPECTED_ORDER), F.col("canonical_name"))
    first = of_sections.filter(F.col("canonical_name").isin(*dims.EXPECTED_ORDER)).groupBy("doc_id", "canonical_name").agg(F.min("section_no").alias("at"))
    w = Window.partitionBy("doc_id").orderBy("at")
    seen = first.withColumn("rank", rank).withColumn("before", F.lag(F.struct("rank", "canonical_name")).over(w))
    return seen.filter(F.col("rank") < F.col("before.rank")).select("doc_id", F.col("before.canonical_name").alias("earlier"), F.col("canonical_name").alias("later"))


def month_index(raw: Column) -> Column:
    """Year * 12 + month of a date in text, OPEN for one still open, null without a year. An unknown month counts as January."""
    named = r"([A-Za-z]+)\.?\s+(\d{4})"
    known = F.expr("map(" + ", ".join(f"'{m}', {i}" for i, m in enumerate(dims.MONTHS, 1)) + ")")
    month = F.coalesce(F.try_element_at(known, F.substring(F.lower(F.regexp_extract(raw, named, 1)), 1, 3)), F.lit(1))
    number = lambda p, g: F.regexp_extract(raw, p, g).try_cast("int")
    iso, slash, year = r"(\d{4})-(\d{1,2})", r"(\d{1,2})/(\d{4})", r"(\d{4})"
    return (
        F.when(raw.rlike("(?i)present|current|now"), OPEN)
        .when(raw.rlike(named), number(named, 2) * 12 + month)
        .when(raw.rlike(iso), number(iso, 1) * 12 + number(iso, 2))
        .when(raw.rlike(slash), number(slash, 2) * 12 + number(slash, 1))
        .when(raw.rlike(year), number(year, 1) * 12 + 1)
    )


PARTS = ("title", "company", "location", "sure")


def header_parts(text: Column) -> Column:
    """Title, company, location and how sure, of a header without its dates; each step is computed once."""
    split = lambda t, sep: F.filter(F.transform(F.split(t, sep), lambda p: F.trim(p)), lambda p: p != "")

    def told(h: Column) -> Column:
        t, pipe, comma, dash = (h[n] for n in ("t", "pipe", "comma", "dash"))
        kind = F.when(t == "", "none").when(F.contains(t, F.lit("|")) & (F.size(pipe) >= 2), "pipe").when(F.contains(t, F.lit(",")) & (F.size(comma) >= 2), "comma").when((h["dashes"] == 1) & (F.size(dash) == 2), "dash").otherwise("whole")
        return bound(kind, lambda k: made(h, k))

    def made(h: Column, kind: Column) -> Column:
        pick = lambda i: F.when(kind == "pipe", F.get(h["pipe"], F.lit(i))).when(kind == "comma", F.get(h["comma"], F.lit(i))).when(kind == "dash", F.get(h["dash"], F.lit(i)))
        sure = F.when(kind == "none", 0.0).when(kind == "pipe", 0.9).when(kind == "comma", 0.75).when(kind == "dash", 0.6).otherwise(0.2)
        return F.struct(F.when(kind == "whole", h["t"]).otherwise(pick(0)).alias("title"), pick(1).alias("company"), pick(2).alias("location"), sure.alias("sure"))

    plain = F.trim(F.btrim(F.btrim(F.btrim(F.trim(text), F.lit(",")), F.lit("|")), F.lit("-")))
    pieces = lambda t: F.struct(t.alias("t"), split(t, r"\|").alias("pipe"), split(t, ",").alias("comma"), split(t, " - | – | — ").alias("dash"), F.regexp_count(t, F.lit(" - | – | — ")).alias("dashes"))
    return bound(plain, lambda t: bound(pieces(t), told))


def experience(of_lines: DataFrame) -> DataFrame:
    """Entries of (doc_id, line_no, line): a dated header that isn't a bullet opens one, following lines are its bullets."""
    line = F.col("line")
    bullet = F.btrim(F.regexp_extract(line, dims.BULLET, 0), F.lit(" ")) != ""
    head = ~bullet & line.rlike(dims.DATE_RANGE)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = of_lines.filter(F.trim("line") != "").withColumn("head", head).withColumn("entry_no", F.sum(F.col("head").cast("int")).over(w))
    bullets = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", F.regexp_replace("line", dims.BULLET, "").alias("text")))))
    grouped = rows.groupBy("doc_id", "entry_no").agg(F.max(F.when(F.col("head"), line)).alias("header"), bullets.alias("b"))
    grouped = grouped.withColumn("p", header_parts(F.coalesce(F.regexp_replace("header", dims.DATE_RANGE, ""), F.lit(""))))
    start, end = first_match("header", dims.DATE_RANGE, 1), first_match("header", dims.DATE_RANGE, 2)
    return grouped.select(
        "doc_id",
        "entry_no",
        *(F.col("p")[n].alias(n) for n in PARTS),
        start.alias("start_raw"),
        end.alias("end_raw"),
        F.coalesce(end.rlike("(?i)present|current|now"), F.lit(False)).alias("is_current"),
        F.transform("b", lambda x: x["text"]).alias("bullets"),
    )


def gaps(ranges: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """Months between a role's start and the end of the one listed after it, where they are many; ranges: doc_id, entry_no, start_m, end_m."""
    w = Window.partitionBy("doc_id").orderBy("entry_no")
    end = F.lead(F.when(F.col("end_m") != OPEN, F.col("end_m"))).over(w)
    start = F.when(F.col("start_m") != OPEN, F.col("start_m"))
    return ranges.select("doc_id", "entry_no", (start - end).cast("long").alias("gap_months")).filter(F.col("gap_months") >= conf.gap_months)


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of roles of a document that share months; a document's roles are few, so its pairs are made in one row."""
    # not a filter: Spark would move it below and read each date once more for it
    role = F.when(F.col("start_m").isNotNull() & F.col("end_m").isNotNull(), F.struct("entry_no", "start_m", "end_m"))
    known = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(role)).alias("roles"))
    shared = lambda x, y: F.least(x["end_m"], y["end_m"]) - F.greatest(x["start_m"], y["start_m"])

    def later(x: Column, i: Column) -> Column:
        rest = F.filter(F.slice("roles", i + 2, F.size("roles")), lambda y: shared(x, y) > 0)
        return F.transform(rest, lambda y: F.struct(x["entry_no"].alias("a"), y["entry_no"].alias("b"), shared(x, y).cast("long").alias("months")))

    return known.select("doc_id", F.explode(F.flatten(F.transform("roles", later))).alias("p")).select("doc_id", "p.*")


def seniority(title: Column) -> Column:
    """Highest level of the whole words of a title; null without any."""
    # the words don't share characters, so one pattern finds them all
    found = F.regexp_extract_all(F.lower(title), F.lit(f"(?<![a-z0-9_])(?:{one_of(dims.SENIORITY)})(?![a-z0-9_])"), F.lit(0))
    level = F.expr("map(" + ", ".join(f"'{k}', {n}L" for k, n in dims.SENIORITY.items()) + ")")
    return F.array_max(F.transform(found, lambda w: F.element_at(level, w)))


def regressions(titles: DataFrame) -> DataFrame:
    """First drop of level over time, of (doc_id, entry_no, title) with the newest entry first; titles without a level are passed over."""
    known = titles.withColumn("level", seniority(F.col("title"))).filter("level IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy(F.desc("entry_no"))
    seen = known.withColumn("before", F.lag(F.struct("level", "title")).over(w)).withColumn("at", F.row_number().over(w))
    drops = seen.filter(F.col("level") < F.col("before.level"))
    return drops.groupBy("doc_id").agg(F.min_by(F.concat_ws(" > ", "before.title", "title"), "at").alias("detail"), F.min_by("level", "at").alias("level"))

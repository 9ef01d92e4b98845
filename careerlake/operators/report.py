"""The whole report on a document, from its text alone: every step is an expression over arrays of a row, so nothing is shuffled.

A null text counts as empty. Time is in proportion to a text's length, but for pairs of roles, which are made within a document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.conf import DEFAULT, Conf
from careerlake.functions import dims
from careerlake.functions.text import bound, few_words, first_match, one_of, strings, total, word_count
from careerlake.operators import detect, match, score, structure

#: Fields of a document besides doc_id and text, and in SQL what stands for one that is missing.
INPUTS = {"filename": "''", "posting": "CAST(NULL AS string)", "n_columns": "CAST(NULL AS int)", "n_table_lines": "0", "n_images": "0", "misspelt": "0"}


#: Of each buzzword its longest run of letters, which stands in long_words of a document that has the buzzword in a bullet.
BUZZ_KEYS = sorted({max(re.findall("[a-z]{4,}", p), key=len) for p in dims.BUZZWORDS})
#: The characters of dims.BULLET.
BULLETS = " \t\n\v\f\r-•*●▪"


def summed(of: Column, value) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + value(x).cast("long"))


def marks_of(lines: Column) -> Column:
    """Lines that open a section: place, name, how it was told, and 0 if the line is its first, 1 if it is used up."""

    def opened(line: Column, i: Column) -> Column:
        first = F.when(structure.header_shaped(line), "other").otherwise("header_block")
        return F.struct(i.alias("i"), structure.heading_of(line).alias("known"), F.when(i == 0, first).alias("first"))

    def told(m: Column) -> Column:
        via = F.when(m["known"].isNotNull(), "dictionary").otherwise("positional_heuristic")
        name = F.coalesce(m["known"], m["first"])
        return F.struct(m["i"].alias("i"), name.alias("name"), via.alias("via"), F.when(name == "header_block", 0).otherwise(1).alias("used"))

    return F.transform(F.filter(F.transform(lines, opened), lambda m: m["known"].isNotNull() | m["first"].isNotNull()), told)


def sections_of(lines: Column, marks: Column) -> Column:
    """Sections with a line or more: name, via, lines."""

    def section(m: Column, k: Column) -> Column:
        end = F.coalesce(F.get(marks, k + 1)["i"], F.size(lines))
        return F.struct(m["name"].alias("name"), m["via"].alias("via"), F.slice(lines, m["i"] + m["used"] + 1, end - m["i"] - m["used"]).alias("lines"))

    return F.filter(F.transform(marks, section), lambda s: F.size(s["lines"]) > 0)


def contact_of(lines: Column) -> dict[str, Column]:
    """The first name, e-mail, phone and profile of the first ten lines, each a column, so that a query makes those that it reads."""
    # what a pattern needs is looked for first: it is rare, and the patterns are dear
    email = lambda x: F.when(F.contains(x, F.lit("@")), first_match(x, dims.EMAIL))
    profile = lambda x: F.when(F.contains(x, F.lit("/")) & F.contains(F.lower(x), F.lit("linkedin")), first_match(x, dims.PROFILE))
    long_enough = lambda p: F.when(F.length(F.regexp_replace(p, r"\D", "")) >= 7, F.trim(p))
    fields = {
        "name": lambda x: F.when(few_words(x, 4) & ~x.rlike(r"\d") & email(x).isNull() & profile(x).isNull(), F.trim(x)),
        "email": email,
        "phone": lambda x: F.when(x.rlike("[0-9]{3}"), bound(F.regexp_extract(x, dims.PHONE, 0), long_enough)),
        "profile": profile,
    }
    return {n: F.get(F.filter(F.transform(F.slice(lines, 1, 10), field), lambda v: v.isNotNull()), F.lit(0)) for n, field in fields.items()}


def entries_of(lines: Column) -> Column:
    """Entries of an experience section: title, company, location, sure, start_raw, end_raw, header, bullets."""
    # a range has a year before what leads to its end, which few lines have, and is dear to look for
    is_head = lambda x: x.rlike("[0-9]{4}\\s*+(?:[-–—]|[tT][oO])") & x.rlike(dims.DATE_RANGE) & (F.btrim(F.regexp_extract(x, dims.BULLET, 0), F.lit(" ")) == "")

    def made(kept: Column, heads: Column) -> Column:
        def entry(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1), F.size(kept))
            header = F.get(kept, F.when(at >= 0, at))
            bullets = F.transform(F.slice(kept, at + 2, end - at - 1), lambda b: F.ltrim(b, F.lit(BULLETS)))
            split = lambda h: structure.header_parts(F.coalesce(F.regexp_replace(h, dims.DATE_RANGE, ""), F.lit("")))
            part = lambda h, g: bound(F.regexp_extract(h, dims.DATE_RANGE, g), lambda m: F.nullif(m, F.lit("")))
            fields = lambda h, p: F.struct(*(p[n].alias(n) for n in structure.PARTS), part(h, 1).alias("start_raw"), part(h, 2).alias("end_raw"), h.alias("header"), bullets.alias("bullets"))
            return bound(header, lambda h: bound(split(h), lambda p: fields(h, p)))

        return F.transform(heads, entry)

    def places(kept: Column) -> Column:
        found = F.filter(F.transform(kept, lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull())
        # lines before the first header make an entry of their own
        return F.when((F.size(kept) > 0) & ~is_head(F.get(kept, F.lit(0))), F.concat(F.array(F.lit(-1)), found)).otherwise(found)

    return bound(F.filter(lines, lambda x: F.trim(x) != ""), lambda kept: bound(places(kept), lambda heads: made(kept, heads)))


def variance(n: Column) -> Column:
    """Of the whole numbers of an array, over all of them, from exact sums; null for none."""
    k = F.size(n).cast("long")
    return F.when(k > 0, (k * summed(n, lambda x: x * x) - summed(n, lambda x: x) * summed(n, lambda x: x)) / (k * k))


def often(found: Column, least: int) -> Column:
    """Different words that stand at least so often; found is sorted."""
    return F.filter(found, lambda w, i: (F.get(found, i + (least - 1)) == w) & ((i == 0) | (F.get(found, i - 1) != w)))


def inversions(ranks: Column) -> Column:
    return F.size(F.filter(ranks, lambda r, i: (i > 0) & (r < F.get(ranks, i - 1))))


def overlapping(ranges: Column) -> Column:
    """Pairs of roles that share months."""
    with_later = lambda a, i: summed(F.filter(ranges, lambda b, j: (j > i) & (F.least(a["end"], b["end"]) > F.greatest(a["start"], b["start"]))), lambda _: F.lit(1))
    return summed(F.transform(ranges, with_later), lambda n: n)


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, lines, sections, contact (and its parts, contact_name and so on), summary, skills, education, entries, bullets, and the inputs, of each row."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(F.col(c) if c in docs.columns else F.expr(default).alias(c) for c, default in INPUTS.items()))
    out = given.withColumn("lines", F.split("text", "\n"))
    out = out.withColumn("marks", marks_of(F.col("lines")))
    contact = contact_of(F.col("lines"))
    out = out.withColumns({"sections": sections_of(F.col("lines"), F.col("marks"))} | {f"contact_{n}": c for n, c in contact.items()})
    had = {n: F.col(f"contact_{n}") for n in contact}
    out = out.withColumn("contact", F.struct(*(c.alias(n) for n, c in had.items()), F.round(total(c.isNotNull() for c in had.values()) / 4, 2).alias("confidence")))
    of = lambda name: F.filter("sections", lambda s: s["name"] == name)
    flat = lambda name: F.flatten(F.transform(of(name), lambda s: s["lines"]))
    items = F.filter(F.flatten(F.transform(flat("skills"), lambda x: F.transform(F.split(x, "[,;]"), lambda p: F.trim(p)))), lambda p: p != "")
    out = out.withColumns(
        {
            "summary": F.array_join(F.try_element_at(of("summary"), F.lit(-1))["lines"], " "),  # the last one
            "skills": items,
            "education": flat("education"),
            "entries": F.flatten(F.transform(of("experience"), lambda s: entries_of(s["lines"]))),
        }
    )
    return out.withColumn("bullets", F.flatten(F.transform("entries", lambda e: e["bullets"]))).drop("marks")


def features(of_parsed: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """The numbers that scores and warnings rest on."""
    bullets, entries, sections, lines = F.col("bullets"), F.col("entries"), F.col("sections"), F.col("lines")
    # no word runs over a line's end; sort_array, as array_sort calls an expression for each two that it compares
    long_words = F.sort_array(F.regexp_extract_all(F.lower(F.array_join(bullets, "\n")), F.lit("[a-z]{4,}"), F.lit(0)))
    names = F.array_distinct(F.filter(F.transform(sections, lambda s: s["name"]), lambda n: n.isin(*dims.EXPECTED_ORDER)))
    dated = F.filter(entries, lambda e: e["start_raw"].isNotNull() & e["end_raw"].isNotNull())
    months = F.transform(dated, lambda e: F.struct(structure.month_index(e["start_raw"]).alias("start"), structure.month_index(e["end_raw"]).alias("end")))
    titles = F.filter(F.transform(entries, lambda e: e["title"]), lambda t: t.isNotNull() & (t != ""))
    old = int(conf.as_of[:4]) - conf.old_graduation
    years = lambda x: F.regexp_extract_all(x, F.lit("(^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])"), F.lit(2))
    # what the patterns need is looked for first: it is rare
    birth = lambda x: F.lower(x).rlike("birth|dob|age[:\\s]|born") & x.rlike(dims.BIRTH)
    tenure = lambda x: F.contains(F.lower(x), F.lit("year")) & F.coalesce(first_match(x, dims.TENURE, 2).try_cast("long") >= conf.long_tenure, F.lit(False))
    # lines that have a key of a phrase that their document has; the pattern is dear
    keyed = F.filter(bullets, lambda b: F.exists("buzz_keys", lambda k: F.contains(F.lower(b), k)))
    said = F.when(F.col("summary") != "", F.concat(keyed, F.array("summary"))).otherwise(keyed)
    phrases = lambda x: F.size(F.regexp_extract_all(F.lower(x), F.lit(rf"(?<!\w){one_of(dims.BUZZWORDS)}(?!\w)"), F.lit(0)))
    out = of_parsed.withColumns({"titles": titles, "dated": months, "long_words": long_words, "n_words": word_count("text").cast("long"), "ranks": F.transform(names, lambda n: F.array_position(strings(dims.EXPECTED_ORDER), n)), "lengths": F.transform(bullets, lambda b: word_count(b).cast("long"))})
    out = out.withColumns({"levels": F.filter(F.reverse(F.transform("titles", structure.seniority)), lambda x: x.isNotNull()), "jd": match.posting_title(F.col("posting")), "ranges": F.filter("dated", lambda r: r["start"].isNotNull() & r["end"].isNotNull()), "buzz_keys": F.array_intersect("long_words", strings(BUZZ_KEYS))})
    gap = lambda r, i: F.coalesce((r["start"] != structure.OPEN) & (F.get("dated", i + 1)["end"] != structure.OPEN) & (r["start"] - F.get("dated", i + 1)["end"] >= conf.gap_months), F.lit(False))
    title = F.get("titles", F.lit(0))
    close = (match.jaccard(match.title_words(title), match.title_words(F.col("jd"))) >= conf.title_overlap) & (structure.seniority(title) == structure.seniority(F.col("jd")))
    return out.withColumns(
        {
            "n_bullets": F.size("bullets").cast("long"),
            "n_quantified": summed(bullets, detect.quantified),
            "n_strong": summed(bullets, detect.strong),
            "n_weak": summed(bullets, detect.weak),
            "length_variance": F.round(variance(F.col("lengths")), 1),
            "n_repeated": F.size(F.filter(often(F.col("long_words"), conf.repeated_at), lambda w: ~w.isin(*dims.STOP_WORDS))).cast("long"),
            "n_out_of_order": inversions(F.col("ranks")).cast("long"),
            "n_unsupported": summed(F.transform(F.filter(F.transform(said, lambda x: F.struct(x.alias("line"), phrases(x).alias("n"))), lambda x: x["n"] > 0), lambda x: F.when(detect.evident(x["line"]), 0).otherwise(x["n"])), lambda n: n),
            "n_gaps": summed(F.transform("dated", gap), lambda g: g),
            "n_overlaps": overlapping(F.col("ranges")),
            "n_age": summed(lines, birth) + summed(lines, tenure) + summed(F.col("education"), lambda x: F.size(F.filter(years(x), lambda y: y.cast("int") <= old))),
            "regression": inversions(F.col("levels")) > 0,
            "n_unsure": summed(entries, lambda e: (e["sure"] < 0.5) & e["header"].isNotNull()),
            "band": detect.length_band(F.col("n_words"), conf),
            "title_close": F.coalesce(close, F.lit(False)),
            "known_sections": F.coalesce(summed(sections, lambda s: s["via"] == "dictionary") / F.nullif(F.size(sections), F.lit(0)), F.lit(0.0)),
        }
    )


def scored(of_features: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """Features with the seven category scores, their composite, and warnings."""
    email = F.col("contact_email")  # not contact.email, for which Spark makes all of the contact
    # columns, not parts of a struct, so that a query which reads one of them doesn't make the others
    ats = detect.ats_columns(F.col("lines"), F.col("filename"), email, conf)
    layout = detect.format_columns(F.col("lines"), F.col("n_columns"), F.col("n_table_lines"), F.col("n_images"), conf)
    out = of_features.withColumns(ats | layout)
    out = out.withColumns({"ats_score": detect.ats_score(email), "layout_score": detect.format_score(), "asked": match.skills_of(F.col("posting"), conf=conf), "had": match.skills_of(F.col("text"), conf=conf)})
    share = lambda kind: match.share_had(F.col("asked"), F.col("had"), kind)
    fields = {"full_name": F.col("contact.name").isNotNull(), "email": email.isNotNull(), "phone": F.col("contact.phone").isNotNull(), "summary": F.coalesce(F.col("summary") != "", F.lit(False)), "experience": F.size("entries") > 0, "skills": F.size("skills") > 0}
    # as its measure has always been: education is never parsed, so that field is never earned
    complete = score.completeness(fields, F.col("known_sections"))
    scores = {
        "ats_essentials": F.col("ats_score"),
        "resume_sections": F.greatest(F.lit(0.0), complete - F.when(F.col("n_out_of_order") > 0, 10).otherwise(0)),
        "content_quality": score.content_score(F.col("n_bullets"), F.round(F.col("n_quantified") / F.greatest("n_bullets", F.lit(1)), 2), F.col("n_strong"), F.col("length_variance"), F.col("misspelt"), F.col("n_repeated")),
        "job_tailoring": score.tailoring_score(F.when(F.col("posting").isNotNull(), share("hard")), share("soft"), F.col("title_close")),
        "recruiter_red_flags": score.red_flags_score(F.col("layout_score"), F.col("band"), F.col("n_overlaps"), F.col("n_unsupported")),
        "bias_and_discrimination": score.bias_score(F.col("n_age")),
        "seniority_and_impact": score.seniority_score(F.col("regression")),
    }
    out = out.withColumn("completeness", complete).withColumns(scores)
    return out.withColumns({"overall": score.composite({n: F.col(n) for n in scores}), "warnings": warnings()})


def warnings() -> Column:
    """What a reader is told, in order: a code for each, with how many where that tells something."""
    counted = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}:"), n.cast("string")))
    return F.array_compact(
        F.array(
            counted("unsure_header", F.col("n_unsure")),
            F.when(F.col("n_bullets") == 0, "no_bullets"),
            counted("repeated_words", F.col("n_repeated")),
            counted("misspelt", F.col("misspelt")),
            counted("sections_out_of_order", F.col("n_out_of_order")),
            F.when(~F.col("email_ok"), "email"),
            F.when(~F.col("dates_ok"), "date_formats"),
            F.when(~F.col("one_column"), "columns"),
            F.when(~F.col("no_table"), "tables"),
            F.when(F.col("band").isin("too_short", "too_long"), F.col("band")),
            counted("unsupported_buzzwords", F.col("n_unsupported")),
            counted("gaps", F.col("n_gaps")),
            counted("overlaps", F.col("n_overlaps")),
            F.when(F.col("regression"), "seniority_regression"),
            F.when(F.col("posting").isNotNull() & F.get("titles", F.lit(0)).isNotNull() & F.col("jd").isNotNull() & ~F.col("title_close"), "title"),
        )
    )


def reports(docs: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """The scored report of (doc_id, text and any of INPUTS)."""
    return scored(features(parsed(docs), conf), conf)

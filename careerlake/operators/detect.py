"""Features of documents, from their lines; one shuffle by document at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.conf import DEFAULT, Conf
from careerlake.functions import dims
from careerlake.functions.text import any_of, bound, first_match, total, words


def quantified(line: Column) -> Column:
    """dims.QUANTIFIED: the same places, told by what begins or ends them, so that no place is tried for its word's sake."""
    return line.rlike("[0-9]|,%") & line.rlike("[0-9,]%|\\$\\s?[0-9]|(?<![a-zA-Z0-9_])[0-9]++[kKmMbB]?(?![a-zA-Z0-9_])")


def has_email(line: Column) -> Column:
    """Whether dims.EMAIL matches: it takes an at sign, which few lines have."""
    return F.contains(line, F.lit("@")) & line.rlike("[a-zA-Z0-9._%+-]@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2}")


def strong(line: Column) -> Column:
    return F.lower(F.btrim(F.get(words(line), F.lit(0)), F.lit(".,;:"))).isin(*dims.STRONG_VERBS)


def weak(line: Column) -> Column:
    low = F.lower(F.trim(line))
    return any_of(low.startswith(w) for w in dims.WEAK_OPENERS)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def matching(pattern: str):
    return lambda x: x.rlike(pattern)


def content_quality(of_lines: DataFrame) -> DataFrame:
    """Per document: lines with words, quantified, strong and weak ones, and the variance of their lengths in words."""
    line = F.col("line")
    rows = of_lines.select("doc_id", "line", F.size(words(line)).cast("long").alias("n")).filter("n > 0")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("bullets"),
        count_if(quantified(line)).alias("quantified"),
        count_if(strong(line)).alias("strong"),
        count_if(weak(line)).alias("weak"),
        F.sum("n").alias("words"),
        F.round(F.var_pop("n"), 4).alias("variance"),
    )


def length_band(n: Column, conf: Conf = DEFAULT) -> Column:
    return F.when(n < conf.too_short, "too_short").when(n <= conf.ideal, "ideal").when(n <= conf.acceptable, "long_but_acceptable").otherwise("too_long")


def repeated_openings(of_lines: DataFrame) -> DataFrame:
    """Opening words that several lines of a document share."""
    opening = F.lower(F.btrim(F.get(words("line"), F.lit(0)), F.lit(".,;:")))
    return of_lines.select("doc_id", opening.alias("word")).filter("word <> ''").groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter("n > 1")


def long_words(docs: DataFrame) -> DataFrame:
    """doc_id, word of each word of four ASCII letters or more that isn't a stop word."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return found.filter(~F.col("word").isin(*dims.STOP_WORDS))


def repetition(docs: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    return long_words(docs).groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= conf.repeated_at)


def word_variety(docs: DataFrame) -> DataFrame:
    """Share of distinct words, 1 where there is none."""
    each = long_words(docs).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    found = each.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    n, d = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return out.select("doc_id", n.alias("n_words"), d.alias("n_distinct"), F.when(n > 0, F.round(d / n, 2)).otherwise(1.0).alias("variety"))


def buzzwords(of_lines: DataFrame, phrases: tuple[str, ...] = dims.BUZZWORDS) -> DataFrame:
    """Each phrase found in a line, and whether evidence stands beside it: a number, or a strong verb anywhere in the line, even within a word."""
    low = F.lower("line")
    pattern = "(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + ")"
    found = F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9_]){pattern}(?![a-z0-9_])"), F.lit(1))
    return of_lines.select("doc_id", "line_no", evident(F.col("line")).alias("evidence"), F.explode(found).alias("phrase"))


def evident(line: Column) -> Column:
    """Whether evidence stands in a line: a number, or a strong verb anywhere, even within a word."""
    return quantified(line) | any_of(F.contains(F.lower(line), F.lit(v)) for v in dims.STRONG_VERBS)


#: dims.DATE_FORMATS in lines joined by line ends: what stands around a date isn't taken up, and none of its blanks ends a line.
JOINED_FORMATS = {n: p.replace("(^|[^A-Za-z0-9_])", r"(?<!\w)").replace("($|[^A-Za-z0-9_])", r"(?!\w)").replace(r"\s", r"[^\S\n]") for n, p in dims.DATE_FORMATS.items()}


def n_date_formats(of: Column) -> Column:
    """How many of dims.DATE_FORMATS some of the lines have; each line is looked at once."""
    dated = F.array_join(F.filter(of, lambda x: x.rlike("[0-9]{4}")), "\n")  # every format has a year
    return bound(dated, lambda d: total(d.rlike(p) for p in JOINED_FORMATS.values()))


def ats_columns(of: Column, filename: Column, email: Column, conf: Conf = DEFAULT) -> dict[str, Column]:
    """Four checks, of lines and two names."""
    split = F.filter(of, lambda x: (F.length(x) > conf.long_url) & F.contains(x, F.lit("://")) & x.rlike(dims.URL))
    email_ok = F.coalesce(~F.split_part(email, F.lit("@"), F.lit(1)).rlike(dims.UNPROFESSIONAL), F.lit(False))
    return {"file_ok": ~filename.rlike(dims.MESSY_FILE), "email_ok": email_ok, "urls_ok": F.size(split) == 0, "dates_ok": n_date_formats(of) < 2}


def ats_score(email: Column) -> Column:
    """Weighted share of the columns of ats_columns(), in a step of their own, as each is read more than once; a check that passes weighs as information."""
    file_ok, email_ok, urls_ok, dates_ok = (F.col(c) for c in ("file_ok", "email_ok", "urls_ok", "dates_ok"))
    info, warning, blocker = (F.lit(dims.SEVERITY[s]) for s in ("info", "warning", "blocker"))
    got = sum((F.when(c, info).otherwise(0.0) for c in (email_ok, urls_ok, dates_ok)), F.when(file_ok, info).otherwise(0.0))
    weight = info + F.when(email_ok, info).when(email.isNull(), blocker).otherwise(warning) + info + F.when(dates_ok, info).otherwise(warning)
    return F.round(100 * got / weight, 1)


def ats_checks(docs: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """ats_columns() of (doc_id, text, filename, email), and their score."""
    checks = ats_columns(F.split("text", "\n"), F.col("filename"), F.col("email"), conf)
    return docs.withColumns(checks).select("doc_id", *checks, ats_score(F.col("email")).alias("score"))


def format_columns(of: Column, n_columns: Column, n_table_lines: Column, n_images: Column, conf: Conf = DEFAULT) -> dict[str, Column]:
    """Columns, table lines, pictures and odd bullets of lines."""
    pattern = dims.ODD_BULLET["compat" if conf.compat else "fixed"]
    odd = F.exists(of, lambda x: F.trim(x).rlike(pattern))
    return {"one_column": F.coalesce(n_columns, F.lit(1)) < 2, "no_table": n_table_lines == 0, "no_image": n_images == 0, "usual_bullets": ~odd}


def format_score() -> Column:
    """Weighted share of the columns of format_columns(), in a step of their own."""
    ok = one, table, _, _ = [F.col(c) for c in ("one_column", "no_table", "no_image", "usual_bullets")]
    info, warning = dims.SEVERITY["info"], dims.SEVERITY["warning"]
    weights = [F.when(one, info).otherwise(warning), F.when(table, info).otherwise(warning), F.lit(info), F.lit(info)]
    got = sum((F.when(c, info).otherwise(0.0) for c in ok), F.lit(0.0))
    return F.round(100 * got / sum(weights, F.lit(0.0)), 1)


def format_risk(docs: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """format_columns() of (doc_id, text, n_columns, n_table_lines, n_images), and their score."""
    made = format_columns(F.split("text", "\n"), F.col("n_columns"), F.col("n_table_lines"), F.col("n_images"), conf)
    return docs.select("doc_id", *(c.alias(n) for n, c in made.items())).withColumn("score", format_score())


def age_bias(of_lines: DataFrame, education: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """doc_id, kind, detail: birth or age stated; long tenure; graduation years long before the as-of date."""
    birth = of_lines.filter(F.col("line").rlike(dims.BIRTH)).select("doc_id", F.lit("birth").alias("kind"), F.lit("").alias("detail"))
    years = first_match("line", dims.TENURE, 2).try_cast("long")
    tenure = of_lines.select("doc_id", years.alias("years")).filter(F.col("years") >= conf.long_tenure).select("doc_id", F.lit("tenure").alias("kind"), F.col("years").cast("string").alias("detail"))
    year = F.explode(F.regexp_extract_all("line", F.lit("(^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])"), F.lit(2))).alias("detail")
    old = F.lit(int(conf.as_of[:4])) - F.col("detail").cast("int") >= conf.old_graduation
    graduation = education.select("doc_id", year).filter(old).select("doc_id", F.lit("graduation").alias("kind"), "detail")
    return birth.unionByName(tenure).unionByName(graduation)


def contacts(of_lines: DataFrame) -> DataFrame:
    """The first e-mail, phone, profile and name in the first ten lines, with the share of the four found."""
    head = of_lines.filter("line_no < 10")
    email, phone, profile = first_match("line", dims.EMAIL), first_match("line", dims.PHONE), first_match("line", dims.PROFILE)
    phone = F.when(F.length(F.regexp_replace(phone, r"\D", "")) >= 7, F.trim(phone))
    n = F.size(words("line"))
    name = F.when(email.isNull() & profile.isNull() & n.between(1, 4) & ~F.col("line").rlike(r"\d"), F.trim("line"))
    made = head.select("doc_id", "line_no", email.alias("email"), phone.alias("phone"), profile.alias("profile"), name.alias("name"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    found = made.groupBy("doc_id").agg(*(first(c) for c in ("name", "email", "phone", "profile")))
    share = total(F.col(c).isNotNull() for c in ("name", "email", "phone", "profile")) / 4
    return found.withColumn("confidence", F.round(share, 2))

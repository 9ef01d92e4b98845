"""Queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.conf import DEFAULT
from careerlake.functions import dims
from careerlake.functions.text import first_match, word_count
from careerlake.operators import detect, spelling
from careerlake.operators.lines import lines
from careerlake.sources.tables import table

LINES = """lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
FIRST = r"lower(trim(coalesce(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')[1], ''), '.,;:'))"
STRONG = f"{FIRST} IN {dims.STRONG_VERBS}"
WEAK = "(" + " OR ".join(f"starts_with(lower(trim(line)), '{w}')" for w in dims.WEAK_OPENERS) + ")"
#: Invented texts hold no phrase of the real list, so the same operator also gets some that they do hold.
PHRASES = (*dims.BUZZWORDS, "and the", "of the", "in the", "que de")
#: In place of a file name, one made of source and id.
FILE = "concat(source, case when doc_id % 7 = 0 then '_final final' when doc_id % 11 = 0 then ' copy of' else '' end, '.pdf')"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def doc_content_quality(spark, sf_dir):
    return detect.content_quality(lines(docs_of(spark, sf_dir)))


QUALITY = rf"""quality AS (SELECT doc_id, count(*) AS bullets, count(*) FILTER (WHERE regexp_matches(line, '{dims.QUANTIFIED}')) AS quantified,
  count(*) FILTER (WHERE {STRONG}) AS strong, count(*) FILTER (WHERE {WEAK}) AS weak, CAST(sum(n) AS BIGINT) AS words, round(var_pop(n), 4) AS variance
  FROM (SELECT *, {WORDS.format("line")} AS n FROM lines) WHERE n > 0 GROUP BY doc_id)"""


def doc_length_band(spark, sf_dir):
    counted = docs_of(spark, sf_dir).select("doc_id", word_count(F.coalesce("text", F.lit(""))).cast("long").alias("n_words"))
    return counted.withColumn("band", detect.length_band(F.col("n_words")))


BAND = "CASE WHEN {0} < 150 THEN 'too_short' WHEN {0} <= 700 THEN 'ideal' WHEN {0} <= 1100 THEN 'long_but_acceptable' ELSE 'too_long' END"


def doc_repetition(spark, sf_dir):
    return detect.repetition(docs_of(spark, sf_dir))


def doc_word_variety(spark, sf_dir):
    return detect.word_variety(docs_of(spark, sf_dir))


LONG = f"long AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents) WHERE word NOT IN {dims.STOP_WORDS})"


def doc_repeated_openings(spark, sf_dir):
    return detect.repeated_openings(lines(docs_of(spark, sf_dir)))


def doc_emails(spark, sf_dir):
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", first_match("line", dims.EMAIL).alias("email")).filter("email IS NOT NULL")


def doc_phones(spark, sf_dir):
    found = lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", first_match("line", dims.PHONE).alias("phone")).filter("phone IS NOT NULL")
    return found.withColumn("valid", F.length(F.regexp_replace("phone", r"\D", "")) >= 7)


def doc_contact(spark, sf_dir):
    return detect.contacts(lines(docs_of(spark, sf_dir)))


def doc_buzzwords(spark, sf_dir):
    found = detect.buzzwords(lines(docs_of(spark, sf_dir)), PHRASES)
    return found.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.count_if(~F.col("evidence")).alias("unsupported"))


def with_file(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.expr(FILE).alias("filename"), first_match("text", dims.EMAIL).alias("email"))


def doc_ats_checks(spark, sf_dir):
    return detect.ats_checks(with_file(docs_of(spark, sf_dir)))


def doc_format_risk(spark, sf_dir):
    docs = docs_of(spark, sf_dir).selectExpr("doc_id", "text", "cast(1 + doc_id % 2 as int) AS n_columns", "cast(doc_id % 3 as int) AS n_table_lines", "cast(doc_id % 5 as int) AS n_images")
    return detect.format_risk(docs)


def doc_age_bias(spark, sf_dir):
    of = lines(docs_of(spark, sf_dir))
    made = F.concat("line", F.expr("case when doc_id % 10 = 0 then ' date of birth 1/2/1970' when doc_id % 10 = 1 then ' age: 45' when doc_id % 10 = 2 then ' with 20+ years of experience' when doc_id % 10 = 3 then ' class of 1998, then 2020' else '' end"))
    of = of.withColumn("line", made)
    return detect.age_bias(of, of)


def doc_spelling(spark, sf_dir):
    """Each misspelt word of each document, the word suggested, and in how many lines it stands."""
    return spelling.misspelt(docs_of(spark, sf_dir).select("doc_id", "text"))


ATS = rf"""ats AS (SELECT doc_id, file_ok, email_ok, urls_ok, dates_ok,
  round(100 * (CASE WHEN file_ok THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN email_ok THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN urls_ok THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN dates_ok THEN 0.2::DOUBLE ELSE 0 END)
    / (0.2::DOUBLE + CASE WHEN email_ok THEN 0.2::DOUBLE WHEN email IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.2::DOUBLE + CASE WHEN dates_ok THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END), 1) AS score
  FROM (SELECT doc_id, email, NOT regexp_matches(filename, '{dims.MESSY_FILE}') AS file_ok, coalesce(NOT regexp_matches(split_part(email, '@', 1), '{dims.UNPROFESSIONAL}'), false) AS email_ok,
    len(list_filter(l, lambda x: regexp_matches(x, '{dims.URL}') AND length(x) > 80)) = 0 AS urls_ok,
    {" + ".join(f"CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) > 0 THEN 1 ELSE 0 END" for p in dims.DATE_FORMATS.values())} < 2 AS dates_ok
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l, {FILE} AS filename, nullif(regexp_extract(text, '{dims.EMAIL}'), '') AS email FROM documents)))"""
BUZZ = rf"""buzz AS (SELECT doc_id, phrase, evidence FROM (SELECT doc_id, unnest(regexp_extract_all(replace(' ' || lower(line) || ' ', ' ', '  '), '[^a-z0-9_]({{0}})[^a-z0-9_]', 1)) AS phrase,
  regexp_matches(line, '{dims.QUANTIFIED}') OR {" OR ".join(f"contains(lower(line), '{v}')" for v in dims.STRONG_VERBS)} AS evidence FROM lines))"""


def spaced(phrases) -> str:
    return "|".join(p.replace(" ", "  ") for p in sorted(phrases, key=lambda p: (-len(p), p)))


def spelling_sql(of: str) -> str:
    """The tables suggested (word, suggestion) and misspelt (doc_id, word, suggestion, n) of the lines in `of`, by comparing every word with the whole dictionary."""
    plain = f"regexp_replace(regexp_replace(coalesce(line, ''), '{dims.EMAIL}', ' ', 'g'), '{dims.LINK}', ' ', 'g')"
    given = ", ".join(f"('{w}')" for w in spelling.taxonomy_words())
    return rf"""spelt AS MATERIALIZED (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace({plain}, '([^A-Za-z])', '\1\1', 'g'), '(^|[^A-Za-z])([a-z]{{3,}})($|[^A-Za-z])', 2)) AS word FROM {of}),
        given(word) AS (VALUES {given}), counted AS MATERIALIZED (SELECT word, count(*) AS n FROM spelt GROUP BY word),
        dictionary AS MATERIALIZED (SELECT word, max(n) AS n FROM (SELECT * FROM counted WHERE n >= {spelling.LEAST} UNION ALL SELECT word, 0 FROM given) GROUP BY word),
        near AS MATERIALIZED (SELECT r.word, k.word AS suggestion, k.n, damerau_levenshtein(r.word, k.word) AS d FROM (SELECT word FROM counted WHERE n < {spelling.LEAST} AND word NOT IN (SELECT word FROM given)) r JOIN dictionary k
          ON length(k.word) BETWEEN length(r.word) - 2 AND length(r.word) + 2 WHERE damerau_levenshtein(r.word, k.word) <= 2),
        suggested AS (SELECT word, arg_min(suggestion, (d, -n, suggestion)) AS suggestion FROM near GROUP BY word),
        misspelt AS (SELECT doc_id, word, suggestion, count(DISTINCT (doc_id, line_no)) AS n FROM spelt JOIN suggested USING (word) GROUP BY ALL)"""


QUERIES = {
    f.__name__: f
    for f in (
        doc_content_quality, doc_length_band, doc_repetition, doc_word_variety, doc_repeated_openings, doc_emails, doc_phones, doc_contact,
        doc_buzzwords, doc_ats_checks, doc_format_risk, doc_age_bias, doc_spelling,
    )
}
SQL = {
    "doc_content_quality": f"WITH {LINES}, {QUALITY} SELECT * FROM quality",
    "doc_length_band": f"SELECT doc_id, n AS n_words, {BAND.format('n')} AS band FROM (SELECT doc_id, CAST({WORDS.format("coalesce(text, '')")} AS BIGINT) AS n FROM documents)",
    "doc_repetition": f"WITH {LONG} SELECT doc_id, word, count(*) AS n FROM long GROUP BY ALL HAVING count(*) >= 4",
    "doc_word_variety": f"""WITH {LONG}, n AS (SELECT doc_id, count(*) AS a, count(DISTINCT word) AS d FROM long GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_words, coalesce(d, 0) AS n_distinct, CASE WHEN a > 0 THEN round(d / a, 2) ELSE 1.0::DOUBLE END AS variety FROM documents LEFT JOIN n USING (doc_id)""",
    "doc_repeated_openings": f"WITH {LINES} SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {FIRST} AS word FROM lines) WHERE word <> '' GROUP BY ALL HAVING count(*) > 1",
    "doc_emails": f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, e AS email FROM (SELECT *, nullif(regexp_extract(line, '{dims.EMAIL}'), '') AS e FROM lines) WHERE e IS NOT NULL",
    "doc_phones": rf"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, p AS phone, length(regexp_replace(p, '\D', '', 'g')) >= 7 AS valid FROM (SELECT *, nullif(regexp_extract(line, '{dims.PHONE}'), '') AS p FROM lines) WHERE p IS NOT NULL",
    "doc_contact": rf"""WITH {LINES}, made AS (SELECT doc_id, line_no, nullif(regexp_extract(line, '{dims.EMAIL}'), '') AS email, nullif(regexp_extract(line, '{dims.PHONE}'), '') AS p,
          nullif(regexp_extract(line, '{dims.PROFILE}'), '') AS profile, {WORDS.format("line")} AS n, line FROM lines WHERE line_no < 10),
        found AS (SELECT *, CASE WHEN length(regexp_replace(p, '\D', '', 'g')) >= 7 THEN trim(p) END AS phone, CASE WHEN email IS NULL AND profile IS NULL AND n BETWEEN 1 AND 4 AND NOT regexp_matches(line, '\d') THEN trim(line) END AS name FROM made),
        firsts AS (SELECT doc_id, {", ".join(f"min_by({c}, line_no) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("name", "email", "phone", "profile"))} FROM found GROUP BY doc_id)
        SELECT *, round(({" + ".join(f"({c} IS NOT NULL)::INT" for c in ("name", "email", "phone", "profile"))}) / 4, 2) AS confidence FROM firsts""",
    "doc_buzzwords": f"WITH {LINES}, {BUZZ.format(spaced(PHRASES))} SELECT doc_id, replace(phrase, '  ', ' ') AS phrase, count(*) AS n, count(*) FILTER (WHERE NOT evidence) AS unsupported FROM buzz GROUP BY ALL",
    "doc_ats_checks": f"WITH {ATS} SELECT * FROM ats",
    "doc_format_risk": r"""SELECT doc_id, a AS one_column, b AS no_table, c AS no_image, d AS usual_bullets, round(100 * (0.2::DOUBLE * (a::INT + b::INT + c::INT + d::INT))
          / (CASE WHEN a THEN 0.2::DOUBLE ELSE 0.5 END + CASE WHEN b THEN 0.2::DOUBLE ELSE 0.5 END + 0.2::DOUBLE + 0.2::DOUBLE), 1) AS score
        FROM (SELECT doc_id, 1 + doc_id % 2 < 2 AS a, doc_id % 3 = 0 AS b, doc_id % 5 = 0 AS c, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '{0}'))) = 0 AS d FROM documents)""".replace("{0}", dims.ODD_BULLET["compat"]),
    "doc_age_bias": rf"""WITH {LINES}, l AS (SELECT doc_id, line || CASE doc_id % 10 WHEN 0 THEN ' date of birth 1/2/1970' WHEN 1 THEN ' age: 45' WHEN 2 THEN ' with 20+ years of experience' WHEN 3 THEN ' class of 1998, then 2020' ELSE '' END AS line FROM lines)
        SELECT doc_id, 'birth' AS kind, '' AS detail FROM l WHERE regexp_matches(line, '{dims.BIRTH}')
        UNION ALL SELECT doc_id, 'tenure', y FROM (SELECT doc_id, nullif(regexp_extract(line, '{dims.TENURE}', 2), '') AS y FROM l) WHERE try_cast(y AS BIGINT) >= 15
        UNION ALL SELECT doc_id, 'graduation', y FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(line, '([^0-9A-Za-z_])', '\1\1', 'g'), '(^|[^0-9A-Za-z_])((?:19|20)[0-9]{{2}})($|[^0-9A-Za-z_])', 2)) AS y FROM l) WHERE {DEFAULT.as_of[:4]} - y::INT >= 20""",
    "doc_spelling": f"WITH {LINES}, {spelling_sql('lines')} SELECT doc_id, word, suggestion, n FROM misspelt",
}


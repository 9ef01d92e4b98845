"""Queries on sections, experience, dates, matches, versions and pages.

The texts at hand have invented words and no headings or dates, so headings are put in by line number, employment is made of orders,
and terms are looked up that the texts do have; plans/reports.py has the whole list of skills.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.functions.text import percent, total
from careerlake.operators import detect, evidence, guard, match, structure
from careerlake.operators.lines import lines
from careerlake.plans import reports
from careerlake.plans.documents import LINES, docs_of
from careerlake.sources.tables import table

LEXICON = ("the", "and", "with", "que", "der", "de", "that", "thing", "tion", "ent", "of", "her", "was", "des")
HEADING = """CASE WHEN line_no = 0 AND doc_id % 3 = 0 THEN 'Jane Doe' WHEN line_no = 0 AND doc_id % 3 = 1 THEN 'WORK EXPERIENCE' WHEN line_no % 5 = 1 AND doc_id % 2 = 0 THEN 'Professional Summary:'
  WHEN line_no % 5 = 2 THEN 'Education' WHEN line_no % 5 = 3 AND doc_id % 4 > 0 THEN ' Work  Experience ' WHEN line_no % 5 = 4 THEN 'Skills & Tools' ELSE line END"""


def headed(spark, sf_dir):
    return lines(docs_of(spark, sf_dir)).select("doc_id", "line_no", F.expr(HEADING).alias("line"))


def doc_sections(spark, sf_dir):
    out = structure.sections(headed(spark, sf_dir))
    return out.groupBy("doc_id", "section_no", "canonical_name", "via").agg(F.count("*").alias("n_lines"), F.min("line_no").cast("long").alias("first_line"))


def doc_section_order(spark, sf_dir):
    """Of documents with headings put in, and of the résumés made of them, whose ids count down from -1."""
    made = lines(reports.cvs(spark, sf_dir).withColumn("doc_id", -F.col("doc_id") - 1))
    return structure.section_order(structure.sections(headed(spark, sf_dir).unionByName(made)))


def doc_completeness(spark, sf_dir):
    """Weighted share of the fields that the sections give; no education is ever parsed, so its weight is never earned."""
    from careerlake.operators import score

    s = structure.sections(headed(spark, sf_dir)).groupBy("doc_id", "section_no", "canonical_name", "via").agg(F.count("*").alias("n"))
    has = lambda name: F.count_if(F.col("canonical_name") == name) > 0
    found = s.groupBy("doc_id").agg(*(has(n).alias(n) for n in ("summary", "experience", "skills")), F.avg((F.col("via") == "dictionary").cast("double")).alias("known"))
    fields = {n: F.col(n) for n in ("summary", "experience", "skills")}
    return found.select("doc_id", score.completeness(fields, F.col("known")).alias("score"))


ENTRY = """concat(CASE o_custkey % 4 WHEN 0 THEN concat('Senior Engineer, ', o_orderpriority, ', Pune') WHEN 1 THEN concat('Manager | Clerk ', CAST(o_custkey AS {0})) WHEN 2 THEN 'Analyst - Acme' ELSE 'Freelance' END,
  ' ', {1}, CASE WHEN o_orderkey % 9 = 0 THEN ' - Present' ELSE concat(' to ', CAST(o_orderkey % 12 + 1 AS {0}), '/', CAST({2} + o_orderkey % 3 AS {0})) END)"""


def employment(spark, sf_dir):
    """Lines of a header and a bullet for each order of a customer, the newest first."""
    orders = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    header = F.expr(ENTRY.format("string", "date_format(o_orderdate, 'MMM yyyy')", "year(o_orderdate)"))
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("n"), header.alias("header"), F.concat(F.lit("- handled "), F.col("o_orderkey").cast("string")).alias("bullet"))
    two = F.explode(F.array(F.struct((F.col("n") * 2 - 2).alias("line_no"), F.col("header").alias("line")), F.struct((F.col("n") * 2 - 1).alias("line_no"), F.col("bullet").alias("line"))))
    return rows.select("doc_id", two.alias("l")).select("doc_id", "l.*")


def experience_entries(spark, sf_dir):
    out = structure.experience(employment(spark, sf_dir))
    return out.select("doc_id", F.col("entry_no").cast("long").alias("entry_no"), "title", "company", "location", "sure", "start_raw", "end_raw", "is_current", F.array_join("bullets", "|").alias("bullets"))


def ranges(spark, sf_dir):
    e = structure.experience(employment(spark, sf_dir))
    return e.select("doc_id", F.col("entry_no").cast("long").alias("entry_no"), structure.month_index(F.col("start_raw")).alias("start_m"), structure.month_index(F.col("end_raw")).alias("end_m"))


def employment_gaps(spark, sf_dir):
    return structure.gaps(ranges(spark, sf_dir))


def employment_overlaps(spark, sf_dir):
    return structure.overlaps(ranges(spark, sf_dir))


TITLE = "concat(CASE o_orderkey % 7 WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'Vice President' WHEN 2 THEN 'Internal coordinator' WHEN 3 THEN 'Lead analyst' WHEN 4 THEN 'Chief of staff' WHEN 5 THEN 'Engineering manager' ELSE 'Gardener' END, ' ', o_orderstatus)"


def titles(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("entry_no"), F.expr(TITLE).alias("title"))


def seniority_level(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(TITLE).alias("title"))
    return t.select("o_orderkey", structure.seniority(F.col("title")).alias("level"))


def seniority_regression(spark, sf_dir):
    return structure.regressions(titles(spark, sf_dir))


def lexicon_scan(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(match.lexicon_skills(F.col("text"), LEXICON), ",").alias("skills"))


def items(spark, sf_dir):
    """Benchmark items numbered from 0 by id."""
    return table(spark, sf_dir, "benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("item_no"), "text")


def wanted(docs, of_items):
    """docs with item_no: each document gets the item at the remainder of its id by the number of items."""
    n = of_items.agg(F.count("*").alias("n_items"))
    return docs.crossJoin(F.broadcast(n)).withColumn("item_no", F.expr("pmod(doc_id, n_items)")).drop("n_items")  # one row


def keyword_coverage(spark, sf_dir):
    """Skills of a benchmark item that a document has, for the item that wanted() gives it."""
    want = items(spark, sf_dir).withColumn("want", match.lexicon_skills(F.col("text"), LEXICON)).drop("text")
    have = wanted(docs_of(spark, sf_dir).select("doc_id", match.lexicon_skills(F.col("text"), LEXICON).alias("have")), want)
    out = have.join(F.broadcast(want), "item_no")  # benchmark items
    return out.select("doc_id", match.coverage(F.col("have"), F.col("want")).alias("pct"), F.array_join(F.array_except("want", "have"), ",").alias("missing"))


#: Names that texts of invented words do hold.
TAXONOMY = {"Articles": ("hard", ("the", "der", "des", "of the")), "Joiners": ("soft", ("and", "and the", "que")), "Thing": ("hard", ("thing", "tion")), "With": ("soft", ("with the", "with"))}


def jd_tailoring(spark, sf_dir):
    """Tailoring of each document to the item that wanted() gives it; an item without skills asks for nothing."""
    had = wanted(docs_of(spark, sf_dir), items(spark, sf_dir)).select("doc_id", "item_no", match.skills_in(F.col("text"), TAXONOMY).alias("had"))
    asked = items(spark, sf_dir).select("item_no", match.skills_in(F.col("text"), TAXONOMY).alias("asked"))
    names = lambda c: F.transform(c, lambda s: s["canonical"])
    share = lambda kind: match.share_had(F.col("asked"), F.col("had"), kind).alias(kind)
    return had.join(asked, "item_no").select("doc_id", share("hard"), share("soft"), F.size(F.array_except(names("asked"), names("had"))).cast("long").alias("missing"))


NAMES = (*dims.SKILLS, "thingtion", "andering", "theresion")


def fuzzy_skill_match(spark, sf_dir):
    """Runs of words near the name of a skill, or of one that the texts at hand come near to."""
    return match.fuzzy_in(docs_of(spark, sf_dir), [n.lower() for n in NAMES])


def title_jaccard(spark, sf_dir):
    """Shared words of the names of neighbouring parts."""
    part = table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("b"))
    out = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a")).join(other, "p_partkey")
    overlap = match.jaccard(match.title_words(F.col("a")), match.title_words(F.col("b")))
    return out.select("p_partkey", F.round(overlap, 4).alias("overlap"))


def parser_agreement(spark, sf_dir):
    """Agreement of customers' fields with a second, altered reading."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.expr("CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN c_name ELSE NULL END").alias("other"))
    ours = F.split(F.lower(F.concat_ws(" ", F.translate("c_name", "#", " "), "c_mktsegment")), " ")
    theirs = F.split(F.lower(F.concat_ws(" ", F.translate("c_name", "#", " "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("NONE"))), " ")
    rate = F.round(match.jaccard(F.array_distinct(ours), F.array_distinct(theirs), 1.0), 2)
    scalar = match.same(F.col("other"), F.col("c_name"))
    return c.select("c_custkey", scalar.alias("name_agrees"), rate.alias("set_agrees"), F.round((scalar.cast("double") + rate) / 2, 2).alias("overall"))


#: Two readings of each order: the second lacks, changes or respells fields by the order's number.
READINGS = """SELECT o_orderkey, concat('Buyer ', o_custkey) AS name, concat('b', o_custkey, '@x.org') AS email, CASE WHEN o_orderkey % 9 > 0 THEN concat('+1 ', o_custkey) END AS phone,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(' BUYER ', o_custkey, ' ') WHEN o_orderkey % 3 = 1 THEN concat('Buyer ', o_custkey) END AS name2, concat('B', o_custkey + CAST(o_orderkey % 4 = 0 AS INT), '@X.org') AS email2, CASE WHEN o_orderkey % 9 > 1 THEN concat('+1 ', o_custkey) END AS phone2,
  {a} o_orderpriority, o_orderstatus, '', 'Spark'{z} AS skills, {a} upper(o_orderpriority), ' spark ', CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END{z} AS skills2, {a} concat('t', o_orderkey % 5), concat('t', o_custkey % 5){z} AS titles, {a} concat('T', o_orderkey % 3), CAST(NULL AS {s}){z} AS titles2,
  {a} CASE WHEN o_orderkey % 4 > 0 THEN 'Acme' END{z} AS companies, {a} CASE WHEN o_orderkey % 4 > 1 THEN 'acme' END, CASE WHEN o_orderkey % 4 = 3 THEN 'Other' END{z} AS companies2 FROM orders"""


def six_field_agreement(spark, sf_dir):
    """How far two readings agree in name, email, phone, skills, titles and companies, and over all six."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    pair = lambda *names: {n: (F.col(n), F.col(f"{n}2")) for n in names}
    agreed = match.agreement(pair("name", "email", "phone"), pair("skills", "titles", "companies"))
    return spark.sql(READINGS.format(a="array(", z=")", s="STRING")).select("o_orderkey", *(c.alias(f"{n}_agreement") for n, c in agreed.items()))


def evidence_search(spark, sf_dir):
    """For each skill the first four parts that mention it."""
    skills = spark.createDataFrame([(s,) for s in ("ring", "bolt", "red", "zzz")], "skill string")
    part = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), evidence.said(F.col("p_name"), F.col("p_type")).alias("said"))
    return evidence.evidence(part, skills).select("skill", F.when(F.size("names") > 0, F.array_join("names", ",")).alias("parts"))


def evidence_terms(spark, sf_dir):
    """For each two words in a row of the benchmark the first four turns that have them, and whether any has."""
    split = F.split(F.lower("text"), " ")
    two = F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda i: F.array_join(F.slice(split, i, 2), " "))
    skills = table(spark, sf_dir, "benchmark").filter(F.size(split) > 1).select(F.explode(two).alias("skill"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("place"), evidence.said(F.col("role"), F.col("text")).alias("said"))
    return evidence.evidence(turns, skills).select("skill", F.array_join("names", ",").alias("turns"), (F.size("names") > 0).alias("shown"))


def evidence_languages(spark, sf_dir):
    """Documents of each language; the empty one isn't one."""
    return evidence.languages(table(spark, sf_dir, "documents").select("lang"), "lang")


def keyword_highlight(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", match.highlights(F.col("text"), ("the", "and the", "que")).alias("n"))


PRESENT, MISSING = ("the", "and the", "que", "der"), ("of", "de", "que", "of the")


def highlight_segments(spark, sf_dir):
    """Terms present and missing marked in each text: how many pieces of each class, and the digest of the text with terms in brackets."""
    parts = docs_of(spark, sf_dir).select("doc_id", match.segments(F.col("text"), PRESENT, MISSING).alias("s"))
    n = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long")
    marked = F.array_join(F.transform("s", lambda x: F.when(x["k"] == "n", x["t"]).when(x["k"] == "p", F.concat(F.lit("["), x["t"], F.lit("|]"))).otherwise(F.concat(F.lit("[|"), x["t"], F.lit("]")))), "")
    return parts.select("doc_id", n("p").alias("n_present"), n("m").alias("n_missing"), F.md5(marked).alias("marked_md5"))


POSTED = "CASE p_partkey % 4 WHEN 0 THEN concat('About us', chr(10), 'Role: ', p_name, ' maker', chr(10), 'bye') WHEN 1 THEN concat('We are hiring a ', p_name, ', now') WHEN 2 THEN concat(chr(10), ' ', p_name, ' ', chr(10), 'more') ELSE 'one two three four five six seven eight nine' END"


def posting_title(spark, sf_dir):
    """Titles of postings made of parts and suppliers."""
    return table(spark, sf_dir, "part").select("p_partkey", match.posting_title(F.expr(POSTED)).alias("title"))


def turns(spark, sf_dir):
    """Neighbouring turns of a conversation as versions of a text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("before"), F.lead("text").over(w).alias("after"))
    return rows.filter("after IS NOT NULL")


def line_change_stats(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", guard.line_changes(F.col("before"), F.col("after")).alias("c")).select("conv_id", "turn", "c.*")


def unsupported_additions(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(guard.unsupported(F.col("before"), F.col("after"), LEXICON)), ";").alias("added"))


def number_facts(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(guard.numbers(F.col("text"))), ";").alias("numbers")).filter("numbers <> ''")


def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in guard.page_text(F.col("html")).items()))


ODD_URL = "CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'ftp://a.example.com/x' WHEN 2 THEN 'http://user:pw@a.example.com' WHEN 3 THEN 'https://10.1.2.3/x' WHEN 4 THEN 'http://[::1]/x' WHEN 5 THEN 'localhost' WHEN 6 THEN 'https://a.corp:443/' ELSE 'shop.example.org:8080/x' END"


def public_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(ODD_URL).alias("u"))
    return rows.select("page_id", guard.public_url(F.col("u")).alias("ok"))


def agent_steps(spark, sf_dir):
    """Runs made of events: a tool by type, its arguments by value."""
    e = table(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("tool"), (F.floor("value") % 5).cast("string").alias("args"), (F.col("value") > 5).alias("ok"))
    return guard.accepted_steps(steps, 40).groupBy("run_id", "kind").agg(F.count("*").alias("n"))


def json_extraction(spark, sf_dir):
    said = F.concat(F.lit("<think>{no}</think> Sure:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", guard.json_in(said).alias("json"))


def bullet_stats(spark, sf_dir):
    """Checks that hold over each line of texts."""
    row = lines(docs_of(spark, sf_dir))
    checks = [detect.has_email(F.col("line")), detect.quantified(F.col("line")), F.col("line").rlike("[A-Z]{4}")]
    return row.select("doc_id", total(checks).alias("n_checks"), percent(total(checks), F.lit(3)).alias("pct"))


H = f"h AS (SELECT doc_id, line_no, {HEADING} AS line FROM lines)"
KNOWN = ", ".join(f"('{w}', '{name}')" for name, ws in dims.SECTIONS.items() for w in ws)
SHAPE = r"""(len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) BETWEEN 1 AND 5 AND ((upper(s) = s AND lower(s) <> s) OR (regexp_matches(s, '\p{L}') AND NOT regexp_matches(s, '(^|[^\p{L}])\p{Ll}') AND NOT regexp_matches(s, '\p{L}\p{Lu}'))))"""
SECTIONS = rf"""known(w, name) AS (VALUES {KNOWN}), {H},
  n AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM h), m AS (SELECT n.*, name FROM n LEFT JOIN known ON w = regexp_replace(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}_\s&]', '', 'g'), '\s+', ' ', 'g')),
  o AS (SELECT *, CASE WHEN name IS NOT NULL THEN name WHEN line_no = 0 AND {SHAPE} THEN 'other' WHEN line_no = 0 THEN 'header_block' END AS opens FROM m),
  p AS (SELECT *, count(opens) OVER w AS section_no, last_value(opens IGNORE NULLS) OVER w AS canonical_name, last_value(CASE WHEN opens IS NOT NULL THEN CASE WHEN name IS NOT NULL THEN 'dictionary' ELSE 'positional_heuristic' END END IGNORE NULLS) OVER w AS via FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  sections AS (SELECT doc_id, section_no, canonical_name, via, count(*) AS n_lines, CAST(min(line_no) AS BIGINT) AS first_line FROM p WHERE opens IS NULL OR opens = 'header_block' GROUP BY ALL)"""
R2 = dims.DATE_RANGE
ENTRIES = rf"""o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS entry_no, o_orderdate, {ENTRY.format("VARCHAR", "strftime(o_orderdate, '%b %Y')", "year(o_orderdate)")} AS header FROM orders),
  e AS (SELECT doc_id, entry_no, o_custkey_kind, header, strftime(o_orderdate, '%b %Y') AS start_raw, CASE WHEN o_orderkey % 9 = 0 THEN 'Present' ELSE concat(o_orderkey % 12 + 1, '/', year(o_orderdate) + o_orderkey % 3) END AS end_raw,
    year(o_orderdate) * 12 + month(o_orderdate) AS start_m, CASE WHEN o_orderkey % 9 = 0 THEN 119988 ELSE (year(o_orderdate) + o_orderkey % 3) * 12 + o_orderkey % 12 + 1 END AS end_m, o_orderkey, o_orderpriority FROM (SELECT o.*, doc_id % 4 AS o_custkey_kind, q.o_orderpriority FROM o JOIN orders q USING (o_orderkey)))"""
LEVEL = "greatest(" + ", ".join(f"CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9_]){k}($|[^a-z0-9_])') THEN {v} END" for k, v in dims.SENIORITY.items()) + ")"
SCAN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({{0}}), '(^|[^a-z0-9+#]){k}($|[^a-z0-9+#])') THEN '{k}' END" for k in LEXICON) + "], lambda x: x IS NOT NULL)"
TAX = ", ".join(f"('{v}', '{c}', '{k}')" for v, c, k, *_ in match.variant_rows(TAXONOMY))
LINESET = r"list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '\r?\n'), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '')"
TURNS = "t AS (SELECT conv_id, turn, text AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations), v AS (SELECT * FROM t WHERE after IS NOT NULL)"
NUMBERS = r"list_distinct(list_transform(regexp_extract_all(regexp_replace({0}, '([^A-Za-z0-9_])', '\1\1', 'g'), '(^|[^A-Za-z0-9_])(\d(?:[\d]|,,|\.\.)*(?:\+\+)?(?:%%)?)', 2), lambda x: regexp_replace(replace(replace(replace(replace(x, ',,', ','), '..', '.'), '++', '+'), '%%', '%'), '[,.]+$', '')))"
SQL = {
    "highlight_segments": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT *, list_transform(regexp_extract_all(text, '(?i)\b(and the|of the|the|que|der|of|de)\b'), lambda x: lower(x)) AS hits FROM t)
        SELECT doc_id, len(list_filter(hits, lambda x: x IN ('the', 'and the', 'que', 'der'))) AS n_present, len(list_filter(hits, lambda x: x IN ('of', 'de', 'of the'))) AS n_missing,
          md5(regexp_replace(text, '(?i)\b(?:(and the|the|que|der)|(of the|of|de))\b', '[\1|\2]', 'g')) AS marked_md5 FROM h""",
    "doc_sections": f"WITH {LINES}, {SECTIONS} SELECT * FROM sections",
    "doc_section_order": " UNION ALL ".join(
        f"""SELECT {doc_id} AS doc_id, earlier, later FROM (WITH {found}, f AS (SELECT doc_id, {name} AS name, min(section_no) AS first_at, list_position({list(dims.EXPECTED_ORDER)}, {name}) AS rank FROM {of} WHERE {name} IN {dims.EXPECTED_ORDER} GROUP BY ALL)
        SELECT doc_id, earlier, name AS later FROM (SELECT *, lag(rank) OVER w AS br, lag(name) OVER w AS earlier FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY first_at)) WHERE rank < br)"""
        for doc_id, found, name, of in (("doc_id", f"{LINES}, {SECTIONS}", "canonical_name", "sections"), ("-doc_id - 1", reports.PARSED, "name", "sec"))
    ),
    "doc_completeness": f"""WITH {LINES}, {SECTIONS} SELECT doc_id, round(100 * ((CASE WHEN bool_or(canonical_name = 'summary') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN bool_or(canonical_name = 'experience') THEN 0.3::DOUBLE ELSE 0 END
        + CASE WHEN bool_or(canonical_name = 'skills') THEN 0.15::DOUBLE ELSE 0 END) + 0.05::DOUBLE * avg((via = 'dictionary')::INT)), 1) AS score FROM sections GROUP BY doc_id""",
    "experience_entries": rf"""WITH {ENTRIES}, read AS (SELECT doc_id, entry_no, o_orderkey, header, regexp_extract(header, '{R2}', 1) AS start_raw, regexp_extract(header, '{R2}', 2) AS end_raw FROM e),
        ent1 AS (SELECT *, trim(trim(trim(trim(trim(regexp_replace(header, '{R2}', '', 'g')), ','), '|'), '-')) AS t FROM read), {reports.SPLIT}
        SELECT doc_id, entry_no, title, company, location, sure, start_raw, end_raw, regexp_matches(end_raw, '(?i)present|current|now') AS is_current, concat('handled ', o_orderkey) AS bullets FROM ent4""",
    "employment_gaps": f"WITH {ENTRIES} SELECT doc_id, entry_no, CAST(g AS BIGINT) AS gap_months FROM (SELECT *, start_m - lead(CASE WHEN end_m <> 119988 THEN end_m END) OVER (PARTITION BY doc_id ORDER BY entry_no) AS g FROM e) WHERE g >= 3",
    "employment_overlaps": f"WITH {ENTRIES} SELECT a.doc_id, a.entry_no AS a, b.entry_no AS b, CAST(least(a.end_m, b.end_m) - greatest(a.start_m, b.start_m) AS BIGINT) AS months FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.entry_no < b.entry_no AND least(a.end_m, b.end_m) > greatest(a.start_m, b.start_m)",
    "seniority_level": f"SELECT o_orderkey, CAST({LEVEL} AS BIGINT) AS level FROM (SELECT o_orderkey, {TITLE} AS title FROM orders)",
    "seniority_regression": f"""WITH t AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS entry_no, {TITLE} AS title FROM orders), k AS (SELECT *, CAST({LEVEL} AS BIGINT) AS level FROM t),
        s AS (SELECT *, lag(level) OVER w AS bl, lag(title) OVER w AS bt FROM k WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY entry_no DESC))
        SELECT doc_id, concat(bt, ' > ', title) AS detail, level FROM s WHERE level < bl QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY entry_no DESC) = 1""",
    "lexicon_scan": f"SELECT doc_id, array_to_string({SCAN.format('text')}, ',') AS skills FROM documents",
    "keyword_coverage": f"""WITH w AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_no, {SCAN.format('text')} AS want FROM benchmark), h AS (SELECT doc_id, ((doc_id % k) + k) % k AS item_no, {SCAN.format('text')} AS have FROM documents, (SELECT count(*) AS k FROM benchmark))
        SELECT doc_id, CASE WHEN len(want) > 0 THEN CAST(floor(100.0 * len(list_filter(want, lambda x: list_contains(have, x))) / len(want) + 0.5) AS BIGINT) END AS pct, array_to_string(list_filter(want, lambda x: NOT list_contains(have, x)), ',') AS missing FROM w JOIN h USING (item_no)""",
    "jd_tailoring": rf"""WITH tax(v, canonical, category) AS (VALUES {TAX}), t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (ORDER BY item_id) - 1, text FROM benchmark),
        hit AS (SELECT DISTINCT side, id, canonical, category FROM t, tax WHERE regexp_matches(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), '(^|[^a-z0-9])' || v || '($|[^a-z0-9])')),
        w AS (SELECT doc_id, ((doc_id % k) + k) % k AS item_no FROM documents, (SELECT count(*) AS k FROM benchmark)),
        a AS (SELECT w.doc_id, i.canonical, i.category, h.id IS NOT NULL AS had FROM w JOIN hit i ON i.side = 'i' AND i.id = item_no LEFT JOIN hit h ON h.side = 'd' AND h.id = w.doc_id AND h.canonical = i.canonical),
        s AS (SELECT doc_id, avg(CASE WHEN category = 'hard' THEN had::INT END) AS hard, avg(CASE WHEN category = 'soft' THEN had::INT END) AS soft, count(*) FILTER (WHERE NOT had) AS missing FROM a GROUP BY doc_id)
        SELECT doc_id, coalesce(round(hard, 2), 1) AS hard, coalesce(round(soft, 2), 1) AS soft, coalesce(missing, 0) AS missing FROM documents LEFT JOIN s USING (doc_id)""",
    "title_jaccard": """WITH p AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(concat(p_name, ' ', p_type)), '[a-z]+')) AS w FROM part) SELECT a.p_partkey, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 4) AS overlap FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""",
    "parser_agreement": """WITH c AS (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 < 2 THEN true END, false) AS same, list_distinct(string_split(lower(concat(replace(c_name, '#', ' '), ' ', c_mktsegment)), ' ')) AS a,
          list_distinct(string_split(lower(concat(replace(c_name, '#', ' '), ' ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NONE' END)), ' ')) AS b FROM customer), r AS (SELECT *, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 2) AS rate FROM c)
        SELECT c_custkey, same AS name_agrees, rate AS set_agrees, round((same::INT + rate) / 2, 2) AS overall FROM r""",
    "evidence_search": "SELECT skill, parts FROM (VALUES ('ring'), ('bolt'), ('red'), ('zzz')) s(skill) LEFT JOIN (SELECT skill, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS parts FROM (SELECT skill, p_partkey FROM part, (VALUES ('ring'), ('bolt'), ('red'), ('zzz')) s(skill) WHERE p_size > 5 AND contains(lower(concat(p_name, ' ', p_type)), skill) QUALIFY row_number() OVER (PARTITION BY skill ORDER BY p_partkey) <= 4) GROUP BY skill) USING (skill)",
    "six_field_agreement": f"""WITH r AS ({READINGS.format(a='[', z=']', s='VARCHAR')}), p AS (SELECT *, {', '.join(f"list_distinct(list_transform(list_filter({n}, lambda v: v <> ''), lambda v: lower(trim(v)))) AS {n}_" for n in ('skills', 'skills2', 'titles', 'titles2', 'companies', 'companies2'))} FROM r),
        j AS (SELECT o_orderkey, {', '.join(f"coalesce(lower(trim({n})) = lower(trim({n}2)), false) AS {n}_agreement" for n in ('name', 'email', 'phone'))},
          {', '.join(f"CASE WHEN len({n}_) + len({n}2_) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect({n}_, {n}2_)) / len(list_distinct(list_concat({n}_, {n}2_))), 2) END AS {n}_agreement" for n in ('skills', 'titles', 'companies'))} FROM p)
        SELECT *, round((name_agreement::INT + email_agreement::INT + phone_agreement::INT + skills_agreement + titles_agreement + companies_agreement) / 6, 2) AS overall_agreement FROM j""",
    "evidence_terms": """WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark), s AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS skill FROM w),
        t AS (SELECT concat_ws('-', conv_id, turn) AS id, conv_id, lower(concat_ws(' ', nullif(role, ''), nullif(text, ''))) AS said FROM conversations),
        h AS (SELECT skill, id, row_number() OVER (PARTITION BY skill ORDER BY conv_id, id) AS n FROM s JOIN t ON contains(said, skill)),
        k AS (SELECT skill, string_agg(id, ',' ORDER BY n) AS turns FROM h WHERE n <= 4 GROUP BY skill) SELECT skill, coalesce(turns, '') AS turns, turns IS NOT NULL AS shown FROM s LEFT JOIN k USING (skill)""",
    "evidence_languages": "SELECT lang AS language, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang",
    "posting_title": f"SELECT p_partkey, {reports.wanted_title('t')} AS title FROM (SELECT p_partkey, {POSTED} AS t FROM part)",
    "line_change_stats": f"""WITH {TURNS}, l AS (SELECT conv_id, turn, {LINESET.format('before')} AS a, {LINESET.format('after')} AS b FROM v), c AS (SELECT *, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n FROM l)
        SELECT conv_id, turn, CAST(n AS BIGINT) AS changed, CAST(len(b) AS BIGINT) AS total, CASE WHEN len(b) > 0 THEN CAST(floor(100.0 * n / len(b) + 0.5) AS BIGINT) ELSE 0 END AS pct FROM c""",
    "unsupported_additions": f"""WITH {TURNS} SELECT conv_id, turn, array_to_string(list_sort(list_concat(list_transform(list_filter({SCAN.format('after')}, lambda x: NOT list_contains({SCAN.format('before')}, x)), lambda x: concat('skill "', x, '"')),
        list_transform(list_filter({NUMBERS.format('after')}, lambda x: NOT list_contains({NUMBERS.format('before')}, x)), lambda x: concat('number "', x, '"')))), ';') AS added FROM v""",
    "number_facts": f"SELECT doc_id, n AS numbers FROM (SELECT doc_id, array_to_string(list_sort({NUMBERS.format('text')}), ';') AS n FROM documents) WHERE n <> ''",
    "page_text": r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?i)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']*)["'']', 1)) AS description,
        trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<noscript.*?</noscript>', ' ', 'gis'), '<svg.*?</svg>', ' ', 'gis'), '<[^>]+>', ' ', 'g'),
          '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS text FROM pages""",
    "public_url": rf"""SELECT page_id, coalesce(lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND NOT contains(a, '@') AND regexp_extract(a, '^([^:\[\]@]*)(?::(\d*))?$', 2) IN ('', '80', '443') AND contains(h, '.')
        AND NOT regexp_matches(h, '^[0-9.]+$') AND NOT regexp_matches(h, '(^|\.)(localhost|local|internal|lan|home|corp)$'), false) AS ok
        FROM (SELECT *, lower(regexp_extract(a, '^([^:\[\]@]*)(?::(\d*))?$', 1)) AS h FROM (SELECT *, regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS a FROM (SELECT page_id, CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS f FROM (SELECT page_id, {ODD_URL} AS u FROM pages))))""",
    "agent_steps": """WITH s AS (SELECT user_id AS run_id, event_id AS step, event_type AS tool, CAST(floor(value) AS BIGINT) % 5 AS args, value > 5 AS ok FROM events),
        k AS (SELECT *, CASE WHEN max(ok::INT) OVER (PARTITION BY run_id, tool, args ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'duplicate' WHEN ok THEN 'ok' ELSE 'error' END AS kind, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n FROM s)
        SELECT run_id, kind, count(*) AS n FROM k WHERE n <= 40 GROUP BY ALL""",
    "json_extraction": r"""SELECT event_id, nullif(regexp_extract(regexp_replace(regexp_replace('<think>{no}</think> Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '``` done', '(?s)<think>.*?</think>', '', 'g'), '```(?:json)?', '', 'g'), '(?s)\{.*\}'), '') AS json FROM events""",
    "bullet_stats": f"WITH {LINES}, c AS (SELECT doc_id, CAST(regexp_matches(line, '{dims.EMAIL}')::INT + regexp_matches(line, '{dims.QUANTIFIED}')::INT + regexp_matches(line, '[A-Z]{{4,}}')::INT AS BIGINT) AS n FROM lines) SELECT doc_id, n AS n_checks, CAST(floor(100.0 * n / 3 + 0.5) AS BIGINT) AS pct FROM c",
    "fuzzy_skill_match": rf"""WITH plain AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM documents), runs AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({reports.RUNS.format("string_split(s, ' ')")}) AS run FROM plain WHERE s <> ''),
        {reports.near_sql("runs", [n.lower() for n in NAMES])} SELECT doc_id, name, arg_min(run, (-score, run)) AS word, round(max(score), 2) AS score FROM runs JOIN scored USING (run) WHERE run <> name GROUP BY doc_id, name""",
    "keyword_highlight": r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9_])', '\1\1', 'g'), '(^|[^a-z0-9_])(?:and  the|and\n\nthe_|the|que)($|[^a-z0-9_])')) AS BIGINT) AS n FROM documents",
}
QUERIES = {name: globals()[name] for name in SQL}

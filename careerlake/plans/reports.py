"""Queries of the whole report: documents are put into the shape that it reads, with the text of each as the bullets of a role."""

from __future__ import annotations

from pyspark.sql import functions as F

from careerlake.conf import DEFAULT
from careerlake.functions import dims
from careerlake.operators import fuzzy, match, report, score, spelling, taxonomy
from careerlake.plans.documents import BAND, FIRST, WORDS, spaced, spelling_sql
from careerlake.sources.tables import spread, table

_EXPERIENCE = """'Work Experience', chr(10), CASE doc_id % 3 WHEN 0 THEN 'Senior Engineer, Acme, Pune Jan 2019 - Present' WHEN 1 THEN 'Analyst - Initech 2019 to Current' ELSE 'Self-employed 05/2020 – Now' END, chr(10),
  coalesce(text, ''), chr(10), 'Manager | Clerk ', CASE doc_id % 2 WHEN 0 THEN '03/2015 to 2018' ELSE 'Mar 2016 - Feb. 2019' END, chr(10), '- Led 5 people', chr(10), '• Responsible for results-driven reports, 40% more', chr(10), '- Managed managed managed and managed stock', chr(10),
  CASE doc_id % 5 WHEN 0 THEN 'Chief of staff, Globex 2012 - 2014' WHEN 1 THEN 'Intern 2016 - 2017' ELSE '' END, chr(10)"""
_EDUCATION = "'Education', chr(10), 'B.Tech, 1999 and 2020', chr(10), CASE doc_id % 4 WHEN 0 THEN 'M.Sc. 2004-2006' ELSE 'M.Sc.' END, chr(10)"
#: A résumé made of a document, in SQL that both engines read.
CV = f"""concat(CASE doc_id % 4 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Profile of a person who has done much in a few years' WHEN 2 THEN 'jane d. doe 2' ELSE 'RESUME' END, chr(10),
  CASE doc_id % 3 WHEN 0 THEN concat('cool', doc_id, '@example.com') WHEN 1 THEN concat('j.doe@example.org, +91 98765 432', doc_id % 10, doc_id % 7) ELSE 'https://www.linkedin.com/in/jane-doe, call 12-34' END, chr(10),
  CASE WHEN doc_id % 5 > 0 THEN concat('Professional Summary:', chr(10), CASE doc_id % 4 WHEN 0 THEN 'Dynamic team player, passionate' WHEN 1 THEN 'Proven track record: led 12 people' ELSE 'Age: 45, with 20+ years of experience' END, chr(10), 'and a hard worker', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 6 = 0 THEN concat({_EDUCATION}) ELSE '' END, {_EXPERIENCE}, CASE WHEN doc_id % 6 > 1 THEN concat({_EDUCATION}) ELSE '' END,
  CASE doc_id % 3 WHEN 0 THEN concat('Skills & Tools', chr(10), 'Python; SQL/Java , react.js,', chr(10), 'Google Analytics, team-work;;') WHEN 1 THEN concat('TECHNICAL SKILLS', chr(10), 'k8s, es6. Ms Excel and (Git)', chr(10), 'critical   thinking, mentoring', chr(10), 'Tablaeu and salesforces, modeling financial') ELSE 'Hobbies' END)"""
POSTING = """CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('About us', chr(10), 'Job Title: Senior Engineer', chr(10), 'Python, SQL and teamwork; forecasting') WHEN 2 THEN 'We are looking for a data analyst, who knows google analytics and Tableau' WHEN 3 THEN concat('Lead manager', chr(10), 'Docker/k8s; communication, Colaboration') ELSE 'one two three four five six seven eight nine' END"""
FILENAME = "concat(coalesce(source, ''), CASE WHEN doc_id % 7 = 0 THEN '_final final' WHEN doc_id % 11 = 0 THEN ' copy of' ELSE '' END, '.pdf')"


def cvs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    made = docs.select("doc_id", F.expr(CV).alias("text"), F.expr(FILENAME).alias("filename"), F.expr(POSTING).alias("posting"), F.expr("cast(1 + doc_id % 2 as int)").alias("n_columns"), F.expr("cast(doc_id % 3 as int)").alias("n_table_lines"), F.expr("cast(doc_id % 4 as int)").alias("n_images"))
    return made


def composite_score(spark, sf_dir):
    """The seven category scores of each document and their composite."""
    out = report.reports(cvs(spark, sf_dir))
    return out.select("doc_id", *dims.CATEGORY_WEIGHTS, "overall")


def report_spelling(spark, sf_dir):
    """Reports with misspelt words counted: content score, composite, and warnings. Numbers alone are joined, not texts."""
    made = cvs(spark, sf_dir)
    narrow = report.reports(made).select("doc_id", "n_bullets", "n_quantified", "n_strong", "length_variance", "n_repeated", *dims.CATEGORY_WEIGHTS, "warnings")
    out = spelling.respelt(narrow, spelling.misspelt(made.select("doc_id", "text")))
    return out.select("doc_id", "misspelt", "content_quality", "overall", F.array_join("warnings", ",").alias("warnings"))


def report_warnings(spark, sf_dir):
    return report.reports(cvs(spark, sf_dir)).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


def resume_fields(spark, sf_dir):
    """What sections and first lines give: contact, summary, skills, education, numbers of entries and bullets."""
    p = report.parsed(cvs(spark, sf_dir))
    return p.select("doc_id", "contact.name", "contact.email", "contact.phone", "contact.profile", "contact.confidence", "summary", F.array_join("skills", "|").alias("skills"), F.array_join("education", "|").alias("education"), F.size("entries").cast("long").alias("n_entries"), F.size("bullets").cast("long").alias("n_bullets"))


def resume_entries(spark, sf_dir):
    # outer, as an inner one has Spark filter by the number of entries below, which parses each text three times
    p = report.parsed(cvs(spark, sf_dir)).select("doc_id", F.posexplode_outer("entries").alias("at", "e")).filter("at IS NOT NULL")
    return p.select("doc_id", F.col("at").cast("long").alias("entry_no"), "e.title", "e.company", "e.location", "e.sure", "e.start_raw", "e.end_raw", F.size("e.bullets").cast("long").alias("n_bullets"))


def parse_completeness(spark, sf_dir):
    """The score and which fields were found."""
    f = report.reports(cvs(spark, sf_dir))
    found = [F.when(c, n) for n, c in (("full_name", F.col("contact.name").isNotNull()), ("email", F.col("contact.email").isNotNull()), ("phone", F.col("contact.phone").isNotNull()), ("summary", F.col("summary") != ""), ("experience", F.size("entries") > 0), ("skills", F.size("skills") > 0), ("sections", F.col("known_sections") >= 0.8))]
    return f.select("doc_id", F.col("completeness").alias("score"), F.array_join(F.array_compact(F.array(*found)), ",").alias("found"))


def bullet_analysis(spark, sf_dir):
    f = report.features(report.parsed(cvs(spark, sf_dir)))
    return f.select("doc_id", "n_bullets", F.when(F.col("n_bullets") > 0, F.round(F.col("n_quantified") / F.col("n_bullets"), 2)).alias("quantified"), "n_weak", "n_strong", F.col("length_variance").alias("variance"), "n_repeated")


def taxonomy_scan(spark, sf_dir):
    """Skills of the whole list in each document: canonical name, category, the variant or the run near the name, how it was found, and how sure."""
    found = cvs(spark, sf_dir).select("doc_id", F.explode_outer(match.skills_of(F.col("text"))).alias("s")).filter("s IS NOT NULL")
    return found.select("doc_id", "s.*")


#: Labels made of the benchmark's passages: each run of four words, and as its other name its last three.
LABELS = """SELECT DISTINCT concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) AS canonical, concat_ws(' ', w[i + 1], w[i + 2], w[i + 3]) AS other
  FROM (SELECT w, explode(sequence(0, size(w) - 4)) AS i FROM (SELECT filter(split(lower(text), '\\\\s+'), x -> x <> '') AS w FROM benchmark) WHERE size(w) > 3)"""


def large_taxonomy(spark, sf_dir):
    """canonical, category, synonyms: the listed skills, and labels of passages, which grow in number with the benchmark."""
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    listed = spark.createDataFrame([(name, kind, list(others)) for name, (kind, others) in dims.SKILLS.items()], "canonical string, category string, synonyms array<string>")
    return listed.unionByName(spark.sql(LABELS).select("canonical", F.lit("passage").alias("category"), F.array("other").alias("synonyms")))


def taxonomy_labels(spark, sf_dir):
    """Skills in each document of a taxonomy that is a table."""
    return taxonomy.skills(cvs(spark, sf_dir).select("doc_id", "text"), large_taxonomy(spark, sf_dir))


def skill_tailoring(spark, sf_dir):
    """Tailoring of each document to its posting; one without skills asks for nothing, and without a posting there is no row."""
    made = cvs(spark, sf_dir).filter("posting IS NOT NULL").select("doc_id", match.skills_of(F.col("posting")).alias("asked"), match.skills_of(F.col("text")).alias("had"))
    names = lambda c: F.transform(c, lambda s: s["canonical"])
    missing = F.array_except(names("asked"), names("had"))
    return made.select("doc_id", match.share_had(F.col("asked"), F.col("had"), "hard").alias("hard"), match.share_had(F.col("asked"), F.col("had"), "soft").alias("soft"), F.size(missing).cast("long").alias("missing"), score.tailoring_score(match.share_had(F.col("asked"), F.col("had"), "hard"), match.share_had(F.col("asked"), F.col("had"), "soft"), F.lit(False)).alias("score"))


def title_tailoring(spark, sf_dir):
    """The newest title beside the posting's, and whether they are close: half of the words shared, and the same level."""
    f = report.features(report.parsed(cvs(spark, sf_dir))).filter("posting IS NOT NULL")
    return f.select("doc_id", F.get("titles", F.lit(0)).alias("title"), F.col("jd").alias("wanted"), F.col("title_close").alias("close"))


# ---------------------------------------------------------------- SQL

R, B = dims.DATE_RANGE, dims.BULLET
KNOWN = ", ".join(f"('{w}', '{name}')" for name, ws in dims.SECTIONS.items() for w in ws)
SHAPE = rf"""({WORDS.format("line")} BETWEEN 1 AND 5 AND ((upper(s) = s AND lower(s) <> s) OR (regexp_matches(s, '\p{{L}}') AND NOT regexp_matches(s, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(s, '\p{{L}}\p{{Lu}}'))))"""
MONTHS = list(dims.MONTHS)


def month(raw: str) -> str:
    """Month index of a date in text, as SQL."""
    named, iso, slash = r"([A-Za-z]+)\.?\s+(\d{4})", r"(\d{4})-(\d{1,2})", r"(\d{1,2})/(\d{4})"
    part = lambda p, g: f"TRY_CAST(regexp_extract({raw}, '{p}', {g}) AS INT)"
    return rf"""CASE WHEN regexp_matches({raw}, '(?i)present|current|now') THEN 119988 WHEN regexp_matches({raw}, '{named}') THEN {part(named, 2)} * 12 + coalesce(nullif(list_position({MONTHS}, substr(lower(regexp_extract({raw}, '{named}', 1)), 1, 3)), 0), 1)
      WHEN regexp_matches({raw}, '{iso}') THEN {part(iso, 1)} * 12 + {part(iso, 2)} WHEN regexp_matches({raw}, '{slash}') THEN {part(slash, 2)} * 12 + {part(slash, 1)} WHEN regexp_matches({raw}, '(\d{{4}})') THEN {part(r"(\d{4})", 1)} * 12 + 1 END"""


def level(title: str) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN regexp_matches(lower({title}), '(^|[^a-z0-9_]){k}($|[^a-z0-9_])') THEN {v} END" for k, v in dims.SENIORITY.items()) + ")"


def wanted_title(text: str) -> str:
    n = lambda s: WORDS.format(s)
    a = rf"trim(regexp_extract({text}, '(?im)^(?:job title|position|role)\s*[:\-]\s*(.+)$', 1))"
    b = rf"trim(regexp_extract({text}, '(?i)^we(?:''re| are) (?:looking for|hiring)\s+an?\s+(.+?)(?:\.|,|\bwho\b|\bto\b)', 1))"
    first = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND {n('x').replace('lambda x: x <>', 'lambda y: y <>')} <= 8)[1]"
    return f"CASE WHEN {n(a)} BETWEEN 2 AND 8 THEN {a} WHEN {n(b)} BETWEEN 2 AND 8 THEN {b} ELSE {first} END"


#: Title, company, location and how sure, from the text t of entries in ent1.
SPLIT = f"""ent2 AS (SELECT *, {", ".join(f"list_filter(list_transform({how}, lambda x: trim(x)), lambda x: x <> '') AS {n}" for n, how in (("pipe", "string_split(t, '|')"), ("comma", "string_split(t, ',')"), ("dash", "regexp_split_to_array(t, ' - | – | — ')")))}, len(regexp_extract_all(t, ' - | – | — ')) AS dashes FROM ent1),
ent3 AS (SELECT *, CASE WHEN t = '' THEN 'none' WHEN contains(t, '|') AND len(pipe) >= 2 THEN 'pipe' WHEN contains(t, ',') AND len(comma) >= 2 THEN 'comma' WHEN dashes = 1 AND len(dash) = 2 THEN 'dash' ELSE 'whole' END AS kind FROM ent2),
ent4 AS (SELECT *, CASE kind WHEN 'whole' THEN t WHEN 'pipe' THEN pipe[1] WHEN 'comma' THEN comma[1] WHEN 'dash' THEN dash[1] END AS title, CASE kind WHEN 'pipe' THEN pipe[2] WHEN 'comma' THEN comma[2] WHEN 'dash' THEN dash[2] END AS company,
  CASE kind WHEN 'pipe' THEN pipe[3] WHEN 'comma' THEN comma[3] WHEN 'dash' THEN dash[3] END AS location, CASE kind WHEN 'none' THEN 0.0::DOUBLE WHEN 'pipe' THEN 0.9 WHEN 'comma' THEN 0.75 WHEN 'dash' THEN 0.6 ELSE 0.2 END AS sure FROM ent3)"""
TITLE_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+'))"
PARSED = rf"""
cv AS (SELECT doc_id, {CV} AS text, {FILENAME} AS filename, {POSTING} AS posting, 1 + doc_id % 2 AS n_columns, doc_id % 3 AS n_table_lines, doc_id % 4 AS n_images FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM cv)),
known(w, name) AS (VALUES {KNOWN}),
n AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines),
m AS (SELECT n.*, name FROM n LEFT JOIN known ON w = regexp_replace(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}_\s&]', '', 'g'), '\s+', ' ', 'g')),
o AS (SELECT *, CASE WHEN name IS NOT NULL THEN name WHEN line_no = 0 AND {SHAPE} THEN 'other' WHEN line_no = 0 THEN 'header_block' END AS opens FROM m),
p AS (SELECT *, count(opens) OVER w AS section_no, last_value(opens IGNORE NULLS) OVER w AS canonical_name,
  last_value(CASE WHEN opens IS NOT NULL THEN CASE WHEN name IS NOT NULL THEN 'dictionary' ELSE 'positional_heuristic' END END IGNORE NULLS) OVER w AS via FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
body AS (SELECT * FROM p WHERE opens IS NULL OR opens = 'header_block'),
sec AS (SELECT doc_id, section_no, canonical_name AS name, via, count(*) AS n, string_agg(line, ' ' ORDER BY line_no) AS joined FROM body GROUP BY ALL),
found AS (SELECT doc_id, line_no, nullif(regexp_extract(line, '{dims.EMAIL}'), '') AS email, nullif(regexp_extract(line, '{dims.PHONE}'), '') AS ph, nullif(regexp_extract(line, '{dims.PROFILE}'), '') AS profile, {WORDS.format("line")} AS k, line FROM lines WHERE line_no < 10),
found2 AS (SELECT *, CASE WHEN length(regexp_replace(ph, '\D', '', 'g')) >= 7 THEN trim(ph) END AS phone, CASE WHEN email IS NULL AND profile IS NULL AND k BETWEEN 1 AND 4 AND NOT regexp_matches(line, '\d') THEN trim(line) END AS name FROM found),
contact AS (SELECT doc_id, {", ".join(f"min_by({c}, line_no) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("name", "email", "phone", "profile"))} FROM found2 GROUP BY doc_id),
summary AS (SELECT doc_id, arg_max(joined, section_no) AS summary FROM sec WHERE name = 'summary' GROUP BY doc_id),
skills AS (SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY line_no, i) AS skills FROM (SELECT doc_id, line_no, trim(unnest(regexp_split_to_array(line, '[,;]'))) AS s, generate_subscripts(regexp_split_to_array(line, '[,;]'), 1) AS i FROM body WHERE canonical_name = 'skills') WHERE s <> '' GROUP BY doc_id),
education AS (SELECT doc_id, string_agg(line, '|' ORDER BY line_no) AS education FROM body WHERE canonical_name = 'education' GROUP BY doc_id),
x AS (SELECT *, regexp_matches(line, '{R}') AND trim(regexp_extract(line, '{B}')) = '' AS head FROM body WHERE canonical_name = 'experience' AND trim(line) <> ''),
e AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS k FROM x),
bul AS (SELECT doc_id, line_no, regexp_replace(line, '{B}', '') AS line FROM e WHERE NOT head),
ent0 AS (SELECT doc_id, section_no, k, max(CASE WHEN head THEN line END) AS header, count(*) FILTER (WHERE NOT head) AS n_bullets FROM e GROUP BY ALL),
ent1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS entry_no, trim(trim(trim(trim(trim(coalesce(regexp_replace(header, '{R}', '', 'g'), '')), ','), '|'), '-')) AS t,
  nullif(regexp_extract(header, '{R}', 1), '') AS start_raw, nullif(regexp_extract(header, '{R}', 2), '') AS end_raw FROM ent0),
{SPLIT},
ent AS (SELECT *, {month("start_raw")} AS start_m, {month("end_raw")} AS end_m FROM ent4)"""
EVIDENCE = rf"""(regexp_matches(line, '{dims.QUANTIFIED}') OR {" OR ".join(f"contains(lower(line), '{v}')" for v in dims.STRONG_VERBS)})"""
#: Runs of one to three of the words {0}.
RUNS = "list_concat({0}, list_concat(list_transform(range(1, len({0})), lambda i: ({0})[i] || ' ' || ({0})[i + 1]), list_transform(range(1, len({0}) - 1), lambda i: ({0})[i] || ' ' || ({0})[i + 1] || ' ' || ({0})[i + 2])))"


def near_sql(runs: str, names) -> str:
    """The table scored: run, name, score of runs near a name, by lengths, edit distance, then the longest common subsequence."""
    at = DEFAULT.fuzzy_at
    keys = {n: fuzzy.sorted_name(n) for n in names}
    rows = ", ".join(f"('{n}', '{k}', MAP {fuzzy.masks(k)})" for n, k in keys.items())
    return rf"""names(name, nkey, places) AS (VALUES {rows}),
keyed AS MATERIALIZED (SELECT run, regexp_replace(array_to_string(list_sort(string_split(run, ' ')), ' '), '[^\x00-\x7F]', chr(1), 'g') AS rkey FROM (SELECT DISTINCT run FROM {runs})),
pairs AS (SELECT DISTINCT rkey, name, nkey, places FROM keyed, names WHERE 200 * least(length(rkey), length(nkey)) >= {at} * (length(rkey) + length(nkey)) AND levenshtein(rkey, nkey) <= (length(rkey) + length(nkey)) * {100 - at} // 100),
lcs AS (SELECT rkey, name, 200.0::DOUBLE * (length(nkey) - bit_count(list_reduce(list_prepend(((1::BIGINT << length(nkey)) - 1)::BIGINT, list_transform(string_split(rkey, ''), lambda c: coalesce(places[c], 0)::BIGINT)), lambda v, u: ((v + (v & u)) | (v - (v & u))) & ((1::BIGINT << length(nkey)) - 1)::BIGINT))) / (length(rkey) + length(nkey)) AS score FROM pairs),
scored AS (SELECT run, name, score FROM keyed JOIN lcs USING (rkey) WHERE score >= {at})"""


TAX = ", ".join(f"('{v}', '{c}', '{k}', '{t}', {i})" for v, c, k, t, i in match.variant_rows())
SKILLED = rf"""tax(v, canonical, category, match_type, ord) AS (VALUES {TAX}),
texts AS (SELECT doc_id, 'had' AS side, text FROM cv UNION ALL SELECT doc_id, 'asked', posting FROM cv WHERE posting IS NOT NULL),
plain AS (SELECT doc_id, side, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM texts),
hit1 AS (SELECT doc_id, side, canonical, category, arg_min(v, ord) AS variant, arg_min(match_type, ord) AS match_type FROM plain, tax WHERE contains(s, v) AND regexp_matches(s, '(^|[^a-z0-9])' || regexp_escape(v) || '($|[^a-z0-9])') GROUP BY ALL),
runs AS MATERIALIZED (SELECT DISTINCT doc_id, side, unnest({RUNS.format("string_split(s, ' ')")}) AS run FROM plain WHERE s <> ''),
{near_sql("runs", dims.SKILLS)},
hit AS (SELECT *, 1.0::DOUBLE AS confidence FROM hit1 UNION ALL SELECT doc_id, side, canonical, category, variant, 'fuzzy', round(score / 100, 2)
  FROM (SELECT doc_id, side, name AS canonical, arg_min(run, (-score, run)) AS variant, max(score) AS score FROM runs JOIN scored USING (run) GROUP BY ALL) JOIN (SELECT DISTINCT canonical, category FROM tax) USING (canonical) ANTI JOIN hit1 USING (doc_id, side, canonical)),
tailored AS (SELECT a.doc_id, avg((h.canonical IS NOT NULL)::INT) FILTER (WHERE a.category = 'hard') AS hard, avg((h.canonical IS NOT NULL)::INT) FILTER (WHERE a.category = 'soft') AS soft, count(*) FILTER (WHERE h.canonical IS NULL) AS missing
  FROM hit a LEFT JOIN hit h ON h.doc_id = a.doc_id AND h.canonical = a.canonical AND h.side = 'had' WHERE a.side = 'asked' GROUP BY a.doc_id)"""
OLD = int(DEFAULT.as_of[:4]) - DEFAULT.old_graduation
FEATURES = rf"""
quality AS (SELECT doc_id, count(*) AS n_bullets, count(*) FILTER (WHERE regexp_matches(line, '{dims.QUANTIFIED}')) AS n_quantified, count(*) FILTER (WHERE {FIRST} IN {dims.STRONG_VERBS}) AS n_strong,
  count(*) FILTER (WHERE {" OR ".join(f"starts_with(lower(trim(line)), '{w}')" for w in dims.WEAK_OPENERS)}) AS n_weak, round((count(*) * sum({WORDS.format("line")} ** 2)::BIGINT - sum({WORDS.format("line")})::BIGINT * sum({WORDS.format("line")})::BIGINT) / (count(*) * count(*)), 1) AS variance FROM bul GROUP BY doc_id),
repeated AS (SELECT doc_id, count(*) AS n_repeated FROM (SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(line), '[a-z]{{4,}}')) AS word FROM bul) WHERE word NOT IN {dims.STOP_WORDS} GROUP BY ALL HAVING count(*) >= {DEFAULT.repeated_at}) GROUP BY doc_id),
ranked AS (SELECT doc_id, name, min(section_no) AS first_at, list_position({list(dims.EXPECTED_ORDER)}, name) AS rank FROM sec WHERE name IN {dims.EXPECTED_ORDER} GROUP BY ALL),
ordered AS (SELECT doc_id, count(*) FILTER (WHERE rank < before) AS n_out FROM (SELECT *, lag(rank) OVER (PARTITION BY doc_id ORDER BY first_at) AS before FROM ranked) GROUP BY doc_id),
said AS (SELECT doc_id, line FROM bul UNION ALL SELECT doc_id, summary FROM summary WHERE summary <> ''),
buzz AS (SELECT doc_id, count(*) AS n_unsupported FROM (SELECT doc_id, unnest(regexp_extract_all(replace(' ' || lower(line) || ' ', ' ', '  '), '[^a-z0-9_]({spaced(dims.BUZZWORDS)})[^a-z0-9_]', 1)) FROM said WHERE NOT {EVIDENCE}) GROUP BY doc_id),
dated AS (SELECT *, lead(end_m) OVER (PARTITION BY doc_id ORDER BY entry_no) AS next_end FROM ent WHERE start_raw IS NOT NULL AND end_raw IS NOT NULL),
gap AS (SELECT doc_id, count(*) AS n_gaps FROM dated WHERE start_m <> 119988 AND next_end <> 119988 AND start_m - next_end >= {DEFAULT.gap_months} GROUP BY doc_id),
overlap AS (SELECT a.doc_id, count(*) AS n_overlaps FROM ent a JOIN ent b ON a.doc_id = b.doc_id AND a.entry_no < b.entry_no AND least(a.end_m, b.end_m) > greatest(a.start_m, b.start_m)
  WHERE a.start_m IS NOT NULL AND a.end_m IS NOT NULL AND b.start_m IS NOT NULL AND b.end_m IS NOT NULL GROUP BY a.doc_id),
aged AS (SELECT doc_id, sum(n) AS n_age FROM (SELECT doc_id, regexp_matches(line, '{dims.BIRTH}')::INT + coalesce(TRY_CAST(regexp_extract(line, '{dims.TENURE}', 2) AS BIGINT) >= {DEFAULT.long_tenure}, false)::INT AS n FROM lines
  UNION ALL SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(line, '([^0-9A-Za-z_])', '\1\1', 'g'), '(^|[^0-9A-Za-z_])((?:19|20)[0-9]{{2}})($|[^0-9A-Za-z_])', 2), lambda y: y::INT <= {OLD})) FROM body WHERE canonical_name = 'education') GROUP BY doc_id),
levels AS (SELECT doc_id, entry_no, {level("title")} AS level FROM ent WHERE title <> ''),
regressed AS (SELECT doc_id, bool_or(level < before) AS regression FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY entry_no DESC) AS before FROM levels WHERE level IS NOT NULL) GROUP BY doc_id),
titles AS (SELECT doc_id, arg_min(title, entry_no) AS title FROM ent WHERE title <> '' GROUP BY doc_id),
unsure AS (SELECT doc_id, count(*) AS n_unsure FROM ent WHERE sure < 0.5 AND header IS NOT NULL GROUP BY doc_id),
known_share AS (SELECT doc_id, avg((via = 'dictionary')::INT) AS share FROM sec GROUP BY doc_id),
has AS (SELECT doc_id, true AS has_entry FROM ent GROUP BY doc_id),
jd AS (SELECT cv.doc_id, title, wanted, CASE WHEN title IS NOT NULL AND wanted IS NOT NULL THEN coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) >= {DEFAULT.title_overlap} AND {level("title")} = {level("wanted")}, false) ELSE false END AS close
  FROM (SELECT *, {TITLE_WORDS.format("title")} AS a, {TITLE_WORDS.format("wanted")} AS b FROM (SELECT doc_id, {wanted_title("posting")} AS wanted FROM cv) LEFT JOIN titles USING (doc_id)) JOIN cv USING (doc_id)),
checks AS (SELECT doc_id, c.email, NOT regexp_matches(filename, '{dims.MESSY_FILE}') AS file_ok, coalesce(NOT regexp_matches(split_part(c.email, '@', 1), '{dims.UNPROFESSIONAL}'), false) AS email_ok,
  len(list_filter(l, lambda x: regexp_matches(x, '{dims.URL}') AND length(x) > {DEFAULT.long_url})) = 0 AS urls_ok, {" + ".join(f"CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) > 0 THEN 1 ELSE 0 END" for p in dims.DATE_FORMATS.values())} < 2 AS dates_ok,
  n_columns < 2 AS one, n_table_lines = 0 AS no_table, n_images = 0 AS no_image, len(list_filter(l, lambda x: regexp_matches(trim(x), '{dims.ODD_BULLET["compat"]}'))) = 0 AS usual
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM cv) LEFT JOIN contact c USING (doc_id)),
f AS (SELECT cv.doc_id, posting, {WORDS.format("text")} AS n_words, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_quantified, 0) AS n_quantified, coalesce(n_strong, 0) AS n_strong, coalesce(n_weak, 0) AS n_weak, variance, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_out, 0) AS n_out, coalesce(n_unsupported, 0) AS n_unsupported,
  coalesce(n_gaps, 0) AS n_gaps, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(n_age, 0) AS n_age, coalesce(regression, false) AS regression, coalesce(n_unsure, 0) AS n_unsure, jd.title, jd.wanted, jd.close, k.* EXCLUDE (doc_id), coalesce(share, 0) AS share,
  c.name, c.phone, coalesce(summary, '') AS summary, coalesce(has_entry, false) AS has_entry, coalesce(skills.n, 0) AS n_skills
  FROM cv LEFT JOIN quality USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN ordered USING (doc_id) LEFT JOIN buzz USING (doc_id) LEFT JOIN gap USING (doc_id) LEFT JOIN overlap USING (doc_id) LEFT JOIN aged USING (doc_id) LEFT JOIN regressed USING (doc_id)
  LEFT JOIN unsure USING (doc_id) LEFT JOIN jd USING (doc_id) LEFT JOIN checks k USING (doc_id) LEFT JOIN known_share USING (doc_id) LEFT JOIN contact c USING (doc_id) LEFT JOIN summary USING (doc_id) LEFT JOIN has USING (doc_id) LEFT JOIN skills USING (doc_id)),
g AS (SELECT *, {BAND.format("n_words")} AS band, round(100 * ({" + ".join(f"CASE WHEN {c} THEN {dims.FIELD_WEIGHTS[n]}::DOUBLE ELSE 0 END" for n, c in (("full_name", "name IS NOT NULL"), ("email", "email IS NOT NULL"), ("phone", "phone IS NOT NULL"), ("summary", "summary <> ''"), ("experience", "has_entry"), ("skills", "n_skills > 0")))} + 0.05::DOUBLE * share), 1) AS complete FROM f)"""
SCORES = f"""
s AS (SELECT g.*, round(100 * ({" + ".join(f"CASE WHEN {c} THEN 0.2::DOUBLE ELSE 0 END" for c in ("file_ok", "email_ok", "urls_ok", "dates_ok"))}) / (0.2::DOUBLE + CASE WHEN email_ok THEN 0.2::DOUBLE WHEN email IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.2::DOUBLE + CASE WHEN dates_ok THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END), 1) AS ats_essentials,
  greatest(0, complete - CASE WHEN n_out > 0 THEN 10 ELSE 0 END)::DOUBLE AS resume_sections,
  CASE WHEN n_bullets = 0 THEN 0 ELSE round(40 * round(n_quantified / n_bullets, 2) + 30 * (n_strong / n_bullets) + (10 - 10 * least(variance / 50, 1)) + 10 + (10 - least(3 * n_repeated, 10)), 1) END::DOUBLE AS content_quality,
  CASE WHEN posting IS NULL THEN 100 ELSE round(70 * coalesce(round(hard, 2), 1) + 20 * coalesce(round(soft, 2), 1) + CASE WHEN close THEN 10 ELSE 0 END, 1) END::DOUBLE AS job_tailoring,
  round(greatest(0, (100 + round(100 * ({" + ".join(f"CASE WHEN {c} THEN 0.2::DOUBLE ELSE 0 END" for c in ("one", "no_table", "no_image", "usual"))}) / (CASE WHEN one THEN 0.2::DOUBLE ELSE 0.5 END + CASE WHEN no_table THEN 0.2::DOUBLE ELSE 0.5 END + 0.2::DOUBLE + 0.2::DOUBLE), 1)) / 2
    - CASE WHEN band IN ('too_short', 'too_long') THEN 15 WHEN band = 'long_but_acceptable' THEN 5 ELSE 0 END - least(10 * n_overlaps, 30) - least(5 * n_unsupported, 20)), 1)::DOUBLE AS recruiter_red_flags,
  (100 - least(8 * n_age, 40))::DOUBLE AS bias_and_discrimination, CASE WHEN regression THEN 80 ELSE 100 END::DOUBLE AS seniority_and_impact
  FROM g LEFT JOIN tailored USING (doc_id))"""
COUNTED = lambda name, n: f"CASE WHEN {n} > 0 THEN '{name}:' || {n} END"
WARNED = [
    COUNTED("unsure_header", "n_unsure"), "CASE WHEN n_bullets = 0 THEN 'no_bullets' END", COUNTED("repeated_words", "n_repeated"), COUNTED("sections_out_of_order", "n_out"), "CASE WHEN NOT email_ok THEN 'email' END", "CASE WHEN NOT dates_ok THEN 'date_formats' END",
    "CASE WHEN NOT one THEN 'columns' END", "CASE WHEN NOT no_table THEN 'tables' END", "CASE WHEN band IN ('too_short', 'too_long') THEN band END", COUNTED("unsupported_buzzwords", "n_unsupported"), COUNTED("gaps", "n_gaps"), COUNTED("overlaps", "n_overlaps"),
    "CASE WHEN regression THEN 'seniority_regression' END", "CASE WHEN posting IS NOT NULL AND title IS NOT NULL AND wanted IS NOT NULL AND NOT close THEN 'title' END",
]
OVERALL = " + ".join(f"round({c} * {w}::DOUBLE, 1)" for c, w in dims.CATEGORY_WEIGHTS.items())
FOUND = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (("full_name", "name IS NOT NULL"), ("email", "email IS NOT NULL"), ("phone", "phone IS NOT NULL"), ("summary", "summary <> ''"), ("experience", "has_entry"), ("skills", "n_skills > 0"), ("sections", "share >= 0.8")))
SQL = {
    "composite_score": f"WITH {PARSED}, {SKILLED}, {FEATURES}, {SCORES} SELECT doc_id, {', '.join(dims.CATEGORY_WEIGHTS)}, round({OVERALL}, 1) AS overall FROM s",
    "report_spelling": f"""WITH {PARSED}, {SKILLED}, {FEATURES}, {spelling_sql("lines")}, wrong AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS misspelt FROM misspelt GROUP BY doc_id),
        {SCORES.replace("+ 10 + (10 - least(3 * n_repeated", "+ (10 - least(3 * coalesce(misspelt, 0), 10)) + (10 - least(3 * n_repeated").replace("FROM g LEFT JOIN", "FROM g LEFT JOIN wrong USING (doc_id) LEFT JOIN").replace("SELECT g.*,", "SELECT g.*, wrong.misspelt,")}
        SELECT doc_id, coalesce(misspelt, 0) AS misspelt, content_quality, round({OVERALL}, 1) AS overall, array_to_string(list_filter([{', '.join([*WARNED[:3], COUNTED("misspelt", "misspelt"), *WARNED[3:]])}], lambda x: x IS NOT NULL), ',') AS warnings FROM s""",
    "report_warnings": f"WITH {PARSED}, {FEATURES} SELECT doc_id, array_to_string(list_filter([{', '.join(WARNED)}], lambda x: x IS NOT NULL), ',') AS warnings FROM g",
    "resume_fields": f"""WITH {PARSED}, counts AS (SELECT doc_id, count(*) AS n_entries, CAST(sum(n_bullets) AS BIGINT) AS n_bullets FROM ent GROUP BY doc_id)
        SELECT cv.doc_id, name, email, phone, profile, round(((name IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (profile IS NOT NULL)::INT) / 4, 2) AS confidence, summary, coalesce(skills, '') AS skills, coalesce(education, '') AS education, coalesce(n_entries, 0) AS n_entries, coalesce(n_bullets, 0) AS n_bullets
        FROM cv LEFT JOIN contact USING (doc_id) LEFT JOIN summary USING (doc_id) LEFT JOIN skills USING (doc_id) LEFT JOIN education USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "resume_entries": f"WITH {PARSED} SELECT doc_id, entry_no, title, company, location, sure, start_raw, end_raw, n_bullets FROM ent",
    "parse_completeness": f"WITH {PARSED}, {FEATURES} SELECT doc_id, complete AS score, array_to_string(list_filter([{FOUND}], lambda x: x IS NOT NULL), ',') AS found FROM g",
    "bullet_analysis": f"WITH {PARSED}, {FEATURES} SELECT doc_id, n_bullets, CASE WHEN n_bullets > 0 THEN round(n_quantified / n_bullets, 2) END AS quantified, n_weak, n_strong, variance, n_repeated FROM g",
    "taxonomy_scan": f"WITH {PARSED}, {SKILLED} SELECT doc_id, canonical, category, variant, match_type, confidence FROM hit WHERE side = 'had'",
    "taxonomy_labels": rf"""WITH {PARSED}, words AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
        named AS (SELECT DISTINCT array_to_string(w[i:i + 3], ' ') AS canonical, array_to_string(w[i + 1:i + 3], ' ') AS other FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM words)),
        every(v, canonical, category, match_type, place) AS (SELECT * FROM (VALUES {TAX}) UNION ALL SELECT canonical, canonical, 'passage', 'exact', 0 FROM named UNION ALL SELECT other, canonical, 'passage', 'synonym', 1 FROM named),
        tax AS (SELECT v, arg_max({{'c': canonical, 'k': category, 't': match_type, 'p': place}}, (canonical, -place)) AS o FROM every GROUP BY v),
        plain AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM cv),
        held AS MATERIALIZED (SELECT doc_id, s, v, o FROM plain, tax WHERE contains(s, v))
        SELECT doc_id, o.c AS canonical, any_value(o.k) AS category, arg_min(v, o.p) AS variant, arg_min(o.t, o.p) AS match_type
        FROM held WHERE regexp_matches(s, '(^|[^a-z0-9])' || regexp_escape(v) || '($|[^a-z0-9])') GROUP BY doc_id, o.c""",
    "skill_tailoring": f"""WITH {PARSED}, {SKILLED} SELECT cv.doc_id, coalesce(round(hard, 2), 1) AS hard, coalesce(round(soft, 2), 1) AS soft, coalesce(missing, 0) AS missing, round(70 * coalesce(round(hard, 2), 1) + 20 * coalesce(round(soft, 2), 1), 1) AS score
        FROM cv LEFT JOIN tailored USING (doc_id) WHERE posting IS NOT NULL""",
    "title_tailoring": f"WITH {PARSED}, {FEATURES} SELECT doc_id, title, wanted, close FROM g WHERE posting IS NOT NULL",
}
QUERIES = {name: globals()[name] for name in SQL}

"""Queries on boards, requests, stored reports and other sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.operators import activity, board, guard, relational
from careerlake.plans.store import AS_OF, J, PAY, SKILLS, jobs
from careerlake.sources import files
from careerlake.sources.tables import shared, table


def job_status(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", board.status(F.col("type")).alias("status"))


def job_ticker(spark, sf_dir):
    """The first eight by price, dear ones first."""
    rows = jobs(spark, sf_dir).withColumn("pay", F.expr(PAY.format("id")))
    return board.ticker(rows, [F.desc("price"), F.asc("id")])


def pill_filter(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    some = rows.filter(board.any_pill(("Bolt", "ECON"))).select(F.lit("some").alias("pills"), "id")
    return some.unionByName(rows.filter(board.any_pill(())).select(F.lit("none").alias("pills"), "id"))


def role_search(spark, sf_dir):
    return jobs(spark, sf_dir).filter(board.mentions("Gear", "role")).select("id", "role")


MARKET = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS demand_today, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'falling' END AS trend, CASE event_id % 4 WHEN 0 THEN concat(' ', event_id, ' h') WHEN 1 THEN concat('-', event_id % 9) WHEN 2 THEN 'soon' END AS hour FROM events"


def falsy_defaults(spark, sf_dir):
    """Answers with defaults in place of what is missing, zero or empty, and hours as numbers."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows = spark.sql(MARKET)
    return rows.select("event_id", board.or_default(F.col("demand_today"), F.lit(dims.MARKET_DEFAULTS["demand_today"])).alias("demand_today"), board.or_default(F.col("trend"), F.lit("rising")).alias("trend"), board.hour_block(F.col("hour")).alias("hour"))


def job_match(spark, sf_dir):
    """Skills of customers beside those of the job that they ask for; some ask for none that there is."""
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("job_id"), F.array(F.lit("ring"), F.lit("Economy"), F.lower("c_mktsegment")).alias("have"))
    out = board.job_match(asked, jobs(spark, sf_dir))
    return out.select("job_id", "role", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


PAGES = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'http://10.0.0.1/' ELSE url END AS url, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type, CASE page_id % 6 WHEN 0 THEN '<p>short</p>' ELSE html END AS html FROM pages"


def readable_pages(spark, sf_dir):
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return files.page_source(spark.sql(PAGES)).select("page_id", "title", F.length("text").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("text"))


def readable_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", files.readable(F.col("text")).alias("text")).filter("text IS NOT NULL")
    return rows.select("doc_id", F.length("text").cast("long").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("text"))


LABELS = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE concat(' ', p_name) END AS preferredLabel, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(p_brand, chr(10), '  ', chr(10), p_type, ', \"', p_size, '\"') END AS altLabels FROM part"


def labelled_list(spark, sf_dir):
    """A list of parts with other labels, written as CSV and read back."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    path = files.new_path(shared(spark), "labels")
    spark.sql(LABELS).select("preferredLabel", "altLabels").write.csv(path, header=True, escape='"', emptyValue='', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = files.labelled_list(spark, path)
    return found.select("canonical", "category", F.array_join("synonyms", "|").alias("synonyms")).groupBy("canonical", "category", "synonyms").agg(F.count("*").alias("n"))


def report_store(spark, sf_dir):
    """Reports appended twice and read back."""
    path = files.new_path(shared(spark), "reports")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.round(F.col("o_totalprice") / 5000, 1).alias("overall"))
    files.save_reports(rows.filter("doc_id % 2 = 0"), path)
    files.save_reports(rows.filter("doc_id % 2 = 1"), path)
    found = files.load_reports(spark, path)
    return found.select(F.get_json_object("report", "$.doc_id").cast("long").alias("doc_id"), "overall", F.get_json_object("report", "$.overall").cast("double").alias("kept"))


def updated_rows(spark, sf_dir):
    """Customers whose balance changed are stamped."""
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit("2024-01-01").alias("updated_at"))
    changes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return relational.touched(before, changes, "c_custkey", F.lit(AS_OF))


ANSWERS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'product' WHEN 1 THEN 'startup' WHEN 2 THEN 'unheard of' WHEN 3 THEN 'service' END AS kind, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS sure, event_id % 2 = 0 AS page_read,
  CASE event_id % 6 WHEN 0 THEN concat('{"tool": "', event_type, '", "args": ', props, '}') WHEN 1 THEN 'Sure: {"final": {"ok": true}} done' WHEN 2 THEN '{"tool": ' WHEN 3 THEN '<think>{"tool": "x"}</think>none' WHEN 4 THEN '{"thought": "hm"}' ELSE concat('```json', chr(10), '{"final": "', event_type, '"}', chr(10), '```') END AS answer FROM events"""


def company_guess(spark, sf_dir):
    """How sure a guess may be, and the option that it selects."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    sure = guard.confidence(F.col("kind"), F.col("sure"), F.col("page_read"))
    return spark.sql(ANSWERS).select("event_id", sure.alias("sure"), guard.preselected(F.col("kind"), sure).alias("option"))


def agent_decisions(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(ANSWERS).select("event_id", *(c.alias(n) for n, c in guard.decision(F.col("answer")).items()))


REQUESTS = """SELECT doc_id, text AS resume_text, CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE 'Data engineer' END AS target_role, CASE doc_id % 3 WHEN 0 THEN '' ELSE 'Pune' END AS city, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN repeat('u', 40) ELSE 'jane' END AS username,
  CASE doc_id % 6 WHEN 0 THEN 'intake' WHEN 1 THEN 'generate' WHEN 2 THEN 'delete' WHEN 3 THEN NULL ELSE 'revise' END AS phase FROM documents"""


def request_faults(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    faults = guard.request_faults({n: F.col(n) for n in dims.REQUEST_LENGTHS}, F.col("phase"))
    return spark.sql(REQUESTS).select("doc_id", F.array_join(faults, ",").alias("faults"))


NOTED = "SELECT conv_id, turn, role, text, CASE turn % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'live' ELSE 'model_estimate' END AS source FROM conversations"


def noted_turns(spark, sf_dir):
    """Notes on turns: skills not mentioned yet, sources not verified, and the turn clipped."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    notes = guard.merged_notes(F.array(F.coalesce("text", F.lit(""))), F.array(F.lit("the"), F.lit("Kubernetes")))
    cautious = guard.with_caveats(F.array(F.lit("as said")), F.array("source"))
    return spark.sql(NOTED).select("conv_id", "turn", (F.size(notes) - 1).cast("long").alias("added"), F.array_join(cautious, "|").alias("caveats"), F.length(guard.history_line(F.col("role"), F.coalesce("text", F.lit("")))).cast("long").alias("n"))


def last_week_flags(spark, sf_dir):
    """Which of the last seven days the current streak of each user covers."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    now = activity.current_streak(days, F.lit(AS_OF).cast("date"))
    flags = activity.last_week(F.col("streak"), F.col("last_day"), F.lit(AS_OF).cast("date"))
    return now.select("user_id", F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), "").alias("flags"))


def live_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in activity.live_dates(F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, o_orderkey % 24, o_orderkey % 60)")).items()))


def goal_tasks(spark, sf_dir):
    """Tasks of each goal (orders of a customer) in their place by hour, with how many of the goal are done: a row for each task."""
    goal = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 24).alias("hour"), (F.col("o_orderstatus") == "F").alias("done"))
    place = F.row_number().over(goal.orderBy("hour", "o_orderkey")).cast("long")
    return rows.select("o_custkey", "o_orderkey", "hour", "done", place.alias("place"), F.count_if("done").over(goal).alias("n_done"), F.count("*").over(goal).alias("n_tasks"))


def sparkline(spark, sf_dir):
    """Demand of a brand, from the sizes of its first four parts, as points of a line in 120 by 36."""
    rows = table(spark, sf_dir, "part")
    four = relational.top_per_group(rows, ["p_brand"], [F.asc("p_partkey")], 4).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("four"))
    demand = board.demand_points(*(F.get("four", F.lit(k))["p_size"] for k in range(4)))
    return four.filter(F.size("four") == 4).select("p_brand", board.line_points(demand).alias("points"))


def first_gaps(spark, sf_dir):
    """The first six missing skills of each user's newest event."""
    newest = relational.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_id", "value"])
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.when((i * 7 + F.col("event_id")) % 3 > 0, F.concat(F.lit("s"), i.cast("string")))), lambda x: x.isNotNull())
    return newest.select("user_id", F.array_join(F.slice(gaps, 1, 6), ",").alias("gaps"))


H = "regexp_extract(hour, '^\\s*([+-]?[0-9]+)', 1)"
TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<noscript.*?</noscript>', ' ', 'gis'), '<svg.*?</svg>', ' ', 'gis'), '<[^>]+>', ' ', 'g'),
          '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"""
JSON = r"nullif(regexp_extract(regexp_replace(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g'), '```(?:json)?', '', 'g'), '(?s)\{.*\}'), '')"
FAULT = lambda n: f"CASE WHEN NOT coalesce(length({n}) BETWEEN {dims.REQUEST_LENGTHS[n][0]} AND {dims.REQUEST_LENGTHS[n][1]}, {str(dims.REQUEST_LENGTHS[n][0] == 0).lower()}) THEN '{n}' END"
SQL = {
    "job_status": f"WITH {J} SELECT id, CASE type WHEN 'Internship' THEN 'internship' WHEN 'Remote' THEN 'remote' ELSE 'open' END AS status FROM jobs",
    "job_ticker": f"WITH {J} SELECT id, upper(substr(city, 1, 3)) AS code, company || ' · ' || role AS label, {PAY.format('id').replace('floor(price) AS STRING', 'CAST(floor(price) AS BIGINT) AS VARCHAR').replace('STRING', 'VARCHAR')} AS info FROM jobs ORDER BY price DESC, id LIMIT 8",
    "pill_filter": f"WITH {J}, {SKILLS} SELECT 'some' AS pills, id FROM jobs JOIN sk USING (id) WHERE contains(lower(role), 'bolt') OR contains(lower(role), 'econ') OR len(list_filter(skills, lambda s: contains(lower(s), 'bolt') OR contains(lower(s), 'econ'))) > 0 UNION ALL SELECT 'none', id FROM jobs",
    "role_search": f"WITH {J}, {SKILLS} SELECT id, role FROM jobs JOIN sk USING (id) WHERE contains(lower(role), 'gear') OR len(list_filter(skills, lambda s: contains(lower(s), 'gear'))) > 0",
    "falsy_defaults": f"SELECT event_id, CASE WHEN coalesce(demand_today, 0) = 0 THEN 75 ELSE demand_today END AS demand_today, CASE WHEN coalesce(trend, '') = '' THEN 'rising' ELSE trend END AS trend, coalesce(TRY_CAST({H} AS INT), 0) AS hour FROM ({MARKET})",
    "job_match": f"""WITH {J}, {SKILLS}, a AS (SELECT c_custkey * 2 AS id, ['ring', 'economy', lower(c_mktsegment)] AS have FROM customer)
        SELECT id AS job_id, role, array_to_string(list_filter(skills, lambda s: list_contains(have, lower(s))), ',') AS matched, array_to_string(list_filter(skills, lambda s: NOT list_contains(have, lower(s))), ',') AS missing FROM a JOIN jobs USING (id) JOIN sk USING (id)""",
    "readable_pages": rf"""WITH p AS (SELECT page_id, substr(html, 1, 200000) AS html FROM ({PAGES}) WHERE regexp_matches(content_type, '(?i)text/html|text/plain|application/xhtml') AND url <> 'http://10.0.0.1/'),
        t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?i)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']*)["'']', 1)) AS description, {TEXT} AS text FROM p)
        SELECT page_id, title, CAST(length(substr(text, 1, 3000)) AS INT) AS n, md5(substr(text, 1, 3000)) AS text FROM t WHERE length(text) >= 80 OR coalesce(description, '') <> ''""",
    "readable_texts": r"SELECT doc_id, length(t) AS n, md5(t) AS text FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) > 80",
    "labelled_list": f"SELECT trim(preferredLabel) AS canonical, 'hard' AS category, array_to_string(list_filter(list_transform(string_split(coalesce(altLabels, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS synonyms, count(*) AS n FROM ({LABELS}) WHERE trim(preferredLabel) <> '' GROUP BY ALL",
    "report_store": "SELECT o_orderkey AS doc_id, round(o_totalprice / 5000, 1) AS overall, round(o_totalprice / 5000, 1) AS kept FROM orders",
    "updated_rows": f"SELECT c_custkey, coalesce(round(m, 2), c_acctbal) AS c_acctbal, CASE WHEN m IS NULL THEN '2024-01-01' ELSE '{AS_OF}' END AS updated_at FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (c_custkey)",
    "company_guess": f"WITH a AS (SELECT event_id, kind, CASE WHEN kind IS NULL THEN 'low' WHEN sure = 'high' AND NOT page_read THEN 'medium' ELSE sure END AS s FROM ({ANSWERS})) SELECT event_id, s AS sure, CASE WHEN s <> 'low' THEN CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.COMPANY_OPTIONS.items())} END END AS option FROM a",
    "agent_decisions": f"""WITH a AS (SELECT event_id, CASE WHEN json_valid({JSON}) THEN CAST({JSON} AS JSON) END AS j FROM ({ANSWERS})), k AS (SELECT event_id, j, CASE WHEN json_extract(j, '$.final') IS NOT NULL THEN 'final' WHEN coalesce(json_extract_string(j, '$.tool'), '') <> '' THEN 'tool' ELSE 'invalid' END AS kind FROM a)
        SELECT event_id, kind, CASE WHEN kind = 'tool' THEN json_extract_string(j, '$.tool') END AS tool FROM k""",
    "request_faults": f"SELECT doc_id, array_to_string(list_filter([{', '.join(FAULT(n) for n in dims.REQUEST_LENGTHS)}, CASE WHEN NOT coalesce(phase IN {dims.PHASES}, false) THEN 'phase' END], lambda x: x IS NOT NULL), ',') AS faults FROM ({REQUESTS})",
    "noted_turns": f"""SELECT conv_id, turn, CAST((NOT contains(lower(coalesce(text, '')), 'the'))::INT + (NOT contains(lower(coalesce(text, '')), 'kubernetes'))::INT AS BIGINT) AS added, CASE WHEN source = 'live' THEN 'as said' ELSE 'as said|Not verified: source ' || source END AS caveats,
        length(role) + 2 + CASE WHEN length(coalesce(text, '')) > 200 THEN 201 ELSE length(coalesce(text, '')) END AS n FROM ({NOTED})""",
    "last_week_flags": f"""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) <= DATE '{AS_OF}'), i AS (SELECT user_id, max(day) AS b, count(*) AS n FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d) GROUP BY user_id, run),
        s AS (SELECT user_id, max(b) AS last, coalesce(max(CASE WHEN DATE '{AS_OF}' - b <= 1 THEN n END), 0) AS streak FROM i GROUP BY user_id)
        SELECT user_id, array_to_string(list_transform(range(6, -1, -1), lambda k: CASE WHEN (DATE '{AS_OF}' - CAST(k AS INT)) <= last AND last - (DATE '{AS_OF}' - CAST(k AS INT)) < streak THEN '1' ELSE '0' END), '') AS flags FROM s""",
    "live_dates": """WITH t AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) AS at_ FROM orders)
        SELECT o_orderkey, strftime(at_, '%A, %-d %B %Y') AS long, strftime(at_, '%d %b %Y') AS short, strftime(at_, '%a, %-d %b %Y, %I:%M %p') AS timed FROM t""",
    "goal_tasks": """SELECT o_custkey, o_orderkey, o_orderkey % 24 AS hour, o_orderstatus = 'F' AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 24, o_orderkey) AS place,
        count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n_done, count(*) OVER (PARTITION BY o_custkey) AS n_tasks FROM orders""",
    "sparkline": """WITH f AS (SELECT p_brand, list(p_size ORDER BY p_partkey) AS z FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 4) GROUP BY p_brand HAVING count(*) = 4),
        d AS (SELECT p_brand, [z[1], floor(1.05::DOUBLE * z[1] + 0.5), z[2], floor((z[2] + z[3]) / 2 + 0.5), z[3], z[4]]::DOUBLE[] AS v FROM f), r AS (SELECT *, list_min(v) - 5 AS lo, list_max(v) + 5 AS hi FROM d)
        SELECT p_brand, array_to_string(list_transform(range(0, 6), lambda i: printf('%.1f', floor(120 * i / 5 * 10 + 0.5) / 10) || ',' || printf('%.1f', floor((36 - 36 * (v[i + 1] - lo) / (hi - lo)) * 10 + 0.5) / 10)), ' ') AS points FROM r""",
    "first_gaps": "SELECT user_id, array_to_string(list_filter(list_transform(range(1, 13), lambda i: CASE WHEN (i * 7 + event_id) % 3 > 0 THEN 's' || i END), lambda x: x IS NOT NULL)[1:6], ',') AS gaps FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
QUERIES = {name: globals()[name] for name in SQL}

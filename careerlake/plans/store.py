"""Queries on stores, boards and activity; the tables stand in for reports, users, postings and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.functions.text import half_up, percent, strings
from careerlake.operators import activity, board, relational
from careerlake.sources.tables import table

USER, AS_OF = 17, "2024-01-20"
CITIES = ("Bengaluru", "Hyderabad", "Mumbai", "Pune", "Delhi NCR", "Chennai", "Remote", "Lucknow")
CITY = "CASE pmod(p_partkey, 8) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CITIES)) + " END"
TYPE = "CASE WHEN pmod(p_partkey, 8) = 6 THEN 'Remote' WHEN p_size % 3 = 0 THEN 'Internship' ELSE 'Full-Time' END"
JOBS = f"SELECT p_partkey AS id, p_name AS role, p_brand AS company, {CITY} AS city, {TYPE} AS type, p_type AS domain, p_retailprice AS price FROM part".replace("pmod(p_partkey, 8)", "p_partkey % 8")


def jobs(spark, sf_dir):
    """Postings of parts; skills are the words of the type and of the name."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("role"),
        F.col("p_brand").alias("company"),
        F.expr(CITY).alias("city"),
        F.expr(TYPE).alias("type"),
        F.col("p_type").alias("domain"),
        F.col("p_retailprice").alias("price"),
        F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("skills"),
    )


def report_lookup(spark, sf_dir):
    return relational.lookup(table(spark, sf_dir, "orders"), "o_orderkey", 33).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def recent_reports(spark, sf_dir):
    return relational.recent(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


def agreement_rate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    some = relational.mean_rate(orders, "o_totalprice", F.col("o_orderpriority") == "1-URGENT").withColumn("parser", F.lit("urgent"))
    return some.unionByName(relational.mean_rate(orders, "o_totalprice", F.col("o_orderpriority") == "unknown").withColumn("parser", F.lit("unknown")))


def fk_orphans(spark, sf_dir):
    return relational.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def unlabelled_documents(spark, sf_dir):
    return relational.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id").select("doc_id")


def row_scope(spark, sf_dir):
    return relational.scoped(table(spark, sf_dir, "events"), "user_id", USER).select("event_id", "event_type")


def either_party(spark, sf_dir):
    return relational.either_party(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", 5).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def college_semi_join(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.allowed(table(spark, sf_dir, "orders"), profiles, ["o_custkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def leaderboard_topk(spark, sf_dir):
    opted = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    named = opted.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return relational.top_per_group(named, ["n_name"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("n_name", "c_custkey", "c_acctbal", F.col("rank").cast("long").alias("rank"))


def weekly_stats(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")
    return table(spark, sf_dir, "events").groupBy(week, "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def quality_quarantine(spark, sf_dir):
    checks = {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice").between(1000, 400000), "customer": F.col("o_custkey") > 0}
    return relational.quarantine(table(spark, sf_dir, "orders"), checks).filter("broken <> ''").select("o_orderkey", "broken")


def daily_activity_dedupe(spark, sf_dir):
    out = relational.once_a_day(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
    return out.select("user_id", "event_type", F.col("day").cast("string").alias("day"), "n")


def signup_profile(spark, sf_dir):
    meta = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("college"))))
    email = F.concat(F.lower(F.translate("c_name", "#", "")), F.lit("@example.com"))
    made = table(spark, sf_dir, "customer").select("c_custkey", meta.alias("meta"), email.alias("email"))
    return made.select("c_custkey", relational.display_name(F.col("meta"), F.col("email")).alias("name"), F.get_json_object("meta", "$.college").alias("college"), relational.invite_code(F.col("c_custkey")).alias("code"))


def latest_upsert(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_id", "event_type", "value"])


def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "events").filter("value > 150").select("user_id").distinct()
    return relational.without(table(spark, sf_dir, "events"), gone, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


def history_cap(spark, sf_dir):
    """The 50 newest entries of each user."""
    out = relational.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


def job_filter(spark, sf_dir):
    j = jobs(spark, sf_dir)
    remote = board.faceted(j, "Remote").select(F.lit("remote").alias("facet"), "id", "city", "type")
    return remote.unionByName(board.faceted(j, "pune", "a", ("Full-Time",)).select(F.lit("pune").alias("facet"), "id", "city", "type"))


def job_search(spark, sf_dir):
    return jobs(spark, sf_dir).filter(board.mentions("ring", "role", "company")).select("id", "role")


PAY = "CASE WHEN {0} % 5 = 0 THEN 'Competitive' ELSE concat('₹', CAST(floor(price) AS STRING), '–', CAST({0} % 90 AS STRING), ' LPA') END"


def job_pay_sort(spark, sf_dir):
    """All jobs, the best paid first."""
    rows = jobs(spark, sf_dir).withColumn("pay", F.expr(PAY.format("id"))).withColumn("pay_rank", board.pay_rank(F.col("pay")))
    return rows.orderBy(F.desc("pay_rank"), "id").select("id", "pay", "pay_rank")


def job_listing(spark, sf_dir):
    title = F.concat(F.lit("<b>"), F.col("role"), F.lit("</b>"), F.expr("CASE WHEN id % 7 = 0 THEN ' intern' WHEN id % 5 = 0 THEN ' (Remote)' ELSE '' END"))
    low = F.when(F.col("id") % 4 > 0, F.floor("price").cast("double") * 1000)
    made = board.listing(title, F.concat("city", F.lit(", India")), low, F.when(F.col("id") % 3 == 0, low * 2))
    return jobs(spark, sf_dir).select("id", *(c.alias(n) for n, c in made.items()))


def city_codes(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n")).withColumn("code", board.city_code(F.col("city")))


def deadlines(spark, sf_dir):
    day = board.deadline(F.lit(AS_OF).cast("date"), (F.col("o_orderkey") % 14))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("deadline"))


def bidirectional_match(spark, sf_dir):
    keywords = strings(("steel", "a", "small brushed", "xyz"))
    some = F.filter("skills", lambda s: F.length(s) > 2)
    return jobs(spark, sf_dir).select("id", board.fit(some, keywords).alias("fit"))


def skill_ring(spark, sf_dir):
    role = F.expr("CASE id % 5 WHEN 0 THEN 'AI engineer' WHEN 1 THEN 'Data analyst' WHEN 2 THEN 'devops' WHEN 3 THEN 'site maintainer' ELSE NULL END")
    have = F.expr("CASE id % 3 WHEN 0 THEN array('python', 'SQL', 'git', 'pandas', 'numpy', 'pytorch') WHEN 1 THEN array('docker', 'GIT', 'linux', 'sql', 'react') ELSE array('oop') END")
    return jobs(spark, sf_dir).select("id", board.ring(role, have).alias("r")).select("id", "r.*")


def intensity(spark, sf_dir):
    by_city = jobs(spark, sf_dir).groupBy("city").agg(F.count("*").alias("jobs"))
    return board.intensity(by_city, "jobs")


def typeahead(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter(F.contains(F.lower("s_name"), F.lit("1"))).orderBy("s_suppkey").limit(8).select("s_suppkey", "s_name")


def goal_progress(spark, sf_dir):
    return activity.progress(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


def peer_percentile(spark, sf_dir):
    """How each customer's balance stands in their nation: share strictly below, place between least and most."""
    c = activity.standing(table(spark, sf_dir, "customer").filter("c_acctbal <> 0"), "c_nationkey", "c_acctbal")
    low, high = F.col("low"), F.col("high")
    place = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (F.col("c_acctbal") - low) / F.greatest(F.lit(1.0), high - low))), 4)
    made = c.select("c_custkey", "n", percent(F.col("below"), F.col("n")).alias("pct_below"), place.alias("place"))
    return made.filter("n >= 2").drop("n")


def leader_pick(spark, sf_dir):
    """The year with the most orders of each priority, the first of equals."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return n.groupBy("o_orderpriority").agg(F.max_by("year", F.struct("n", (-F.col("year")).alias("early"))).alias("year"), F.max("n").alias("n"))


def provenance(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 10").groupBy("event_type").agg(F.count("*").alias("n"))


def best_match(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", (-F.col("l_linenumber")).alias("early"))).alias("line"), F.max("l_quantity").alias("quantity"))


def trend_series(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("#"), F.row_number().over(w).cast("string")).alias("label"))


def current_streak(spark, sf_dir):
    out = activity.current_streak(activity.days(table(spark, sf_dir, "events")), F.lit(AS_OF).cast("date"))
    return out.withColumn("last_day", F.col("last_day").cast("string"))


def streak_states(spark, sf_dir):
    return activity.streak_states(activity.days(table(spark, sf_dir, "events"))).withColumn("day", F.col("day").cast("string"))


def streak_states_live(spark, sf_dir):
    return activity.streak_states(activity.days(table(spark, sf_dir, "events")), longest_on_first=False).withColumn("day", F.col("day").cast("string"))


def activity_calendar(spark, sf_dir):
    out = activity.calendar(activity.days(table(spark, sf_dir, "events")), F.lit(AS_OF).cast("date"))
    return out.withColumn("day", F.col("day").cast("string"))


def recent_activity(spark, sf_dir):
    rows = relational.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    age = F.unix_timestamp(F.lit("2024-02-15 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return rows.select("user_id", "event_id", activity.age_label(age).alias("age"))


def issue_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in activity.issue(F.add_months("o_orderdate", 360)).items()))


def anonymous_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", activity.pseudonym(F.col("c_name"), F.col("c_mktsegment")).alias("name"))


def heat_cards(spark, sf_dir):
    """Postings of a city with any of the skills."""
    return jobs(spark, sf_dir).filter((F.col("city") == "Pune") & F.arrays_overlap("skills", strings(("ECONOMY", "ring")))).select("id")


def price_points(spark, sf_dir):
    """Six points of a line from low to high, as half-up numbers."""
    step = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: half_up(F.col("low") + (F.col("high") - F.col("low")) * i / 5).cast("string"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return rows.select("p_brand", F.array_join(step, " ").alias("points"))


DAYS = "days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)"
ISLANDS = "islands AS (SELECT user_id, min(day) AS a, max(day) AS b, count(*) AS n FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM {0}) GROUP BY user_id, run)"
STATES = f"""WITH {DAYS}, g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM days),
    r AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS run FROM g), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY day) AS streak FROM r)
    SELECT user_id, CAST(day AS VARCHAR) AS day, streak, max({{0}}) OVER (PARTITION BY user_id ORDER BY day) AS longest, CASE WHEN gap > 1 THEN 'reset' ELSE 'incremented' END AS action, CASE WHEN streak IN (3, 7, 30) THEN streak END AS milestone FROM s"""
J = f"jobs AS ({JOBS})"
SKILLS = "sk AS (SELECT p_partkey AS id, string_split(p_type || ' ' || p_name, ' ') AS skills FROM part)"
RING = ", ".join(f"('{k}', {list(v)})" for k, v in dims.RING_SKILLS.items())
CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.CITY_CODES.items())
SQL = {
    "report_lookup": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 33",
    "recent_reports": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "agreement_rate": "SELECT p AS parser, count(o_orderkey) AS n, round(avg(o_totalprice), 3) AS mean_rate FROM (VALUES ('urgent', '1-URGENT'), ('unknown', 'unknown')) t(p, q) LEFT JOIN orders ON o_orderpriority = q GROUP BY p",
    "unlabelled_documents": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "fk_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "row_scope": f"SELECT event_id, event_type FROM events WHERE user_id = {USER}",
    "either_party": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 5 OR l_suppkey = 5",
    "college_semi_join": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderstatus",
    "leaderboard_topk": "SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 QUALIFY rank <= 3",
    "weekly_stats": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "quality_quarantine": "SELECT o_orderkey, b AS broken FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'status' END, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 'price' END, CASE WHEN NOT o_custkey > 0 THEN 'customer' END) AS b FROM orders) WHERE b <> ''",
    "daily_activity_dedupe": "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL",
    "signup_profile": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(replace(c_name, '#', '')) END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS college, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 6)) AS code FROM customer",
    "latest_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "cascade_delete": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150) GROUP BY user_id",
    "history_cap": "SELECT user_id, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) GROUP BY user_id",
    "job_filter": f"WITH {J} SELECT 'remote' AS facet, id, city, type FROM jobs WHERE type = 'Remote' UNION ALL SELECT 'pune', id, city, type FROM jobs WHERE contains(lower(city), 'pune') AND contains(lower(domain), 'a') AND type = 'Full-Time'",
    "job_search": f"WITH {J}, {SKILLS} SELECT id, role FROM jobs JOIN sk USING (id) WHERE contains(lower(role), 'ring') OR contains(lower(company), 'ring') OR len(list_filter(skills, lambda s: contains(lower(s), 'ring'))) > 0",
    "job_pay_sort": rf"WITH {J} SELECT id, pay, coalesce(try_cast(regexp_replace(pay, '\D', '', 'g') AS BIGINT), 0) AS pay_rank FROM (SELECT *, {PAY.format('id').replace('floor(price) AS STRING', 'CAST(floor(price) AS BIGINT) AS VARCHAR').replace('STRING', 'VARCHAR')} AS pay FROM jobs) ORDER BY pay_rank DESC, id",
    "job_listing": f"""WITH {J} SELECT id, role || CASE WHEN id % 7 = 0 THEN ' intern' WHEN id % 5 = 0 THEN ' (Remote)' ELSE '' END AS role, city,
        CASE WHEN id % 7 = 0 OR contains(lower(role), 'intern') THEN 'Internship' WHEN id % 5 = 0 OR contains(lower(role), 'remote') THEN 'Remote' ELSE 'Full-Time' END AS type,
        CASE WHEN id % 4 = 0 THEN 'Competitive' ELSE concat('₹', CAST(floor(low / 100000 + 0.5) AS BIGINT), '–', CAST(floor(CASE WHEN id % 3 = 0 THEN low * 2 ELSE low * 1.3::DOUBLE END / 100000 + 0.5) AS BIGINT), ' LPA') END AS pay FROM (SELECT *, floor(price) * 1000 AS low FROM jobs)""",
    "city_codes": f"WITH {J} SELECT city, count(*) AS n, coalesce(CASE city {CODES} END, upper(substr(city, 1, 3))) AS code FROM jobs GROUP BY city",
    "deadlines": f"SELECT o_orderkey, CAST(DATE '{AS_OF}' + coalesce([5, 7, 10, 12, 15, 18, 20, 21, 25, 30][o_orderkey % 14 + 1], 14) AS VARCHAR) AS deadline FROM orders",
    "bidirectional_match": f"""WITH {SKILLS}, s AS (SELECT id, list_filter(skills, lambda x: length(x) > 2) AS s FROM sk)
        SELECT id, CASE WHEN len(s) > 0 THEN CAST(floor(100.0 * len(list_filter(s, lambda x: len(list_filter(['steel', 'a', 'small brushed', 'xyz'], lambda k: contains(k, lower(x)) OR contains(lower(x), k))) > 0)) / len(s) + 0.5) AS BIGINT) END AS fit FROM s""",
    "skill_ring": f"""WITH r(role, needed) AS (VALUES {RING}), p AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'data' WHEN 2 THEN 'cloud' WHEN 3 THEN 'ai' ELSE 'sde' END AS role,
          CASE p_partkey % 3 WHEN 0 THEN ['python', 'sql', 'git', 'pandas', 'numpy', 'pytorch'] WHEN 1 THEN ['docker', 'git', 'linux', 'sql', 'react'] ELSE ['oop'] END AS have FROM part),
        g AS (SELECT id, len(list_filter(needed, lambda s: list_contains(have, lower(s)))) AS a, len(needed) AS n FROM p JOIN r USING (role))
        SELECT id, CAST(a AS BIGINT) AS acquired, CAST(floor(100.0 * a / n + 0.5) AS BIGINT) AS pct, CASE WHEN a / n >= 0.745 THEN 'success' WHEN a / n >= 0.495 THEN 'warning' ELSE 'destructive' END AS band FROM g""",
    "intensity": f"WITH {J}, n AS (SELECT city, count(*) AS jobs FROM jobs GROUP BY city) SELECT *, CAST(max(jobs) OVER () AS BIGINT) AS peak, CAST(sum(jobs) OVER () AS BIGINT) AS total, CAST(floor(100.0 * jobs / max(jobs) OVER () + 0.5) AS BIGINT) AS pct, floor(100.0 * jobs / max(jobs) OVER () + 0.5) > 85 AS hot FROM n",
    "typeahead": "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_suppkey LIMIT 8",
    "goal_progress": "SELECT *, CAST(floor(100.0 * done / total + 0.5) AS BIGINT) AS pct FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS total FROM orders GROUP BY o_orderpriority)",
    "peer_percentile": """SELECT c_custkey, CAST(floor(100.0 * (rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1) / n + 0.5) AS BIGINT) AS pct_below, round(greatest(0, least(100, 100 * (c_acctbal - lo) / greatest(1, hi - lo))), 4) AS place
        FROM (SELECT *, count(*) OVER w AS n, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WHERE c_acctbal <> 0 WINDOW w AS (PARTITION BY c_nationkey)) WHERE n >= 2""",
    "leader_pick": "SELECT o_orderpriority, CAST(year AS INTEGER) AS year, n FROM (SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, year) = 1",
    "provenance": "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type",
    "best_match": "SELECT l_orderkey, l_linenumber AS line, l_quantity AS quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1",
    "trend_series": "SELECT o_orderkey, concat('#', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS label FROM orders",
    "current_streak": f"WITH {DAYS}, d AS (SELECT * FROM days WHERE day <= DATE '{AS_OF}'), {ISLANDS.format('d')} SELECT user_id, max(CASE WHEN DATE '{AS_OF}' - b <= 1 THEN n ELSE 0 END) AS streak, max(n) AS longest, CAST(max(b) AS VARCHAR) AS last_day FROM islands GROUP BY user_id",
    "streak_states": STATES.format("streak"),
    "streak_states_live": STATES.format("CASE WHEN streak > 1 THEN streak ELSE 0 END"),
    "activity_calendar": f"WITH {DAYS} SELECT user_id, CAST(d AS VARCHAR) AS day, days.user_id IS NOT NULL AS active FROM (SELECT user_id, CAST(unnest(range(DATE '{AS_OF}' - 29, DATE '{AS_OF}' + 1, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT user_id FROM days)) u LEFT JOIN days ON days.user_id = u.user_id AND days.day = d".replace("SELECT user_id, CAST(d", "SELECT u.user_id, CAST(d", 1),
    "recent_activity": """SELECT user_id, event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, 'm ago') WHEN m < 1440 THEN concat(m // 60, 'h ago') ELSE concat(m // 1440, 'd ago') END AS age
        FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-02-15 00:00:00') - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5)""",
    "issue_label": """SELECT o_orderkey, CAST(greatest(1, (y - 2025) * 12 + m) AS BIGINT) AS issue_number, concat(CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m <= 5 THEN 'Spring' WHEN m <= 8 THEN 'Summer' ELSE 'Fall' END, ' ’', substr(CAST(y AS VARCHAR), 3, 2)) AS season_year,
        concat(upper(strftime(d, '%b')), '.', y) AS month_year, CAST(quarter(d) AS BIGINT) AS quarter FROM (SELECT o_orderkey, d, year(d) AS y, month(d) AS m FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 360 MONTH AS DATE) AS d FROM orders))""",
    "anonymous_name": f"""SELECT c_custkey, concat({list(dims.ANIMALS)}[CAST(list_reduce(list_concat([0::HUGEINT], list_transform(string_split(c_name, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296) % 24 AS BIGINT) + 1], ' from ', substr(regexp_split_to_array(c_mktsegment, '\\s|,|\\(')[1], 1, 8)) AS name FROM customer""",
    "heat_cards": f"WITH {J}, {SKILLS} SELECT id FROM jobs JOIN sk USING (id) WHERE city = 'Pune' AND list_has_any(skills, ['ECONOMY', 'ring'])",
    "price_points": "SELECT p_brand, array_to_string(list_transform(range(6), lambda i: CAST(floor(lo + (hi - lo) * i / 5 + 0.5) AS BIGINT)), ' ') AS points FROM (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand)",
}
QUERIES = {name: globals()[name] for name in SQL}

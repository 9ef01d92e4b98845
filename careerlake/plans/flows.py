"""Streams over the events, and positioned spans made of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from careerlake.operators import lines
from careerlake.sources.files import new_path
from careerlake.sources.keyed import KeyedTable
from careerlake.sources.tables import shared, table
from careerlake.streaming import streams

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, sf_dir):
    return streams.arriving(spark, sf_dir, "events.parquet", EVENTS)


def stream_dedupe(spark, sf_dir):
    """Activity once a day by user and type."""
    out = streams.run(streams.once_a_day(events(spark, sf_dir), ["user_id", "event_type"]))
    return out.select("user_id", "event_type", F.col("day").cast("string").alias("day"))


def stream_latest(spark, sf_dir):
    out = streams.run(streams.latest(events(spark, sf_dir), "user_id", "event_id", ["event_id", "event_type", "value"]), "update")
    return streams.newest(out, "user_id")


def stream_change_feed(spark, sf_dir):
    """The newest entry of each user and type, kept as a table; an error of a value under 2 deletes its entry."""
    kept = KeyedTable(spark, new_path(shared(spark), "keyed"), EVENTS, ("user_id", "event_type"), ("ts", "event_id"))
    gone = (F.col("event_type") == "error") & (F.col("value") < 2)
    return streams.into(events(spark, sf_dir), kept, gone).read().select("user_id", "event_type", "event_id", "value")


def stream_streaks(spark, sf_dir):
    """States of all days, the last written of each."""
    out = streams.newest(streams.run(streams.streaks(events(spark, sf_dir))), "user_id", "day")
    return out.select("user_id", F.col("day").cast("string").alias("day"), "streak", "longest", "action", "milestone")


def stream_frames(spark, sf_dir):
    """Frames of each user's properties, cut in two anywhere and put together again."""
    frame = F.concat(F.lit(streams.PREFIX), "props", F.lit(streams.FRAME_END))
    at = (F.pmod("event_id", F.length(frame)) + 1).cast("int")
    cut = F.explode(F.array(F.struct((F.col("event_id") * 2).alias("seq"), F.substring(frame, F.lit(1), at).alias("chunk")), F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.substring(frame, at + 1, F.length(frame)).alias("chunk"))))
    chunks = events(spark, sf_dir).filter("props IS NOT NULL").select(F.col("user_id").alias("conn"), "ts", cut.alias("c")).select("conn", "ts", "c.*")
    return streams.run(streams.frames(chunks)).drop("batch")


#: Spans of a supplier's order lines: every fourth line is twelve apart, a third of them stand in a second column on odd pages.
SPANS = """SELECT l_suppkey AS doc_id, l_linenumber % 3 AS page, CAST(CASE WHEN l_linenumber % 3 = 1 AND l_orderkey % 3 = 0 THEN 320 + l_orderkey % 25 ELSE 40 + l_orderkey % 30 END AS DOUBLE) AS x0,
  CAST(100 + (l_orderkey % 40) * 12 + l_partkey % 3 AS DOUBLE) AS y0, concat(l_returnflag, l_orderkey, '.', l_linenumber, '.', l_partkey) AS text FROM lineitem"""


def spans(spark, sf_dir):
    """Different spans, as repeated ones have no order; by document, so that what follows needs no other shuffle."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(SPANS).repartition("doc_id").distinct()


def page_columns(spark, sf_dir):
    s = spans(spark, sf_dir)
    return lines.page_columns(s, s.select("doc_id", "page").distinct())


def max_columns(spark, sf_dir):
    """Most columns of any page of a document, one at least."""
    return page_columns(spark, sf_dir).groupBy("doc_id").agg(F.greatest(F.lit(1).cast("long"), F.max("n_columns")).alias("n_columns"))


def ordered(spark, sf_dir):
    return lines.placed(lines.split_pages(spans(spark, sf_dir)))


def reading_order(spark, sf_dir):
    return ordered(spark, sf_dir).select("doc_id", F.col("place").cast("long").alias("place"), "page", F.col("column").cast("long").alias("column"), "text")


def span_lines(spark, sf_dir):
    return lines.span_lines(ordered(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def text_layer(spark, sf_dir):
    """Whether documents have more than 20 characters of text; those of few lines have not."""
    few = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("  "), "l_returnflag", F.col("l_quantity").cast("int").cast("string"), F.lit(" ")).alias("text"))
    return lines.has_text_layer(few)


WORDS = "SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber % 2 AS block, 0 AS paragraph, CAST(floor(l_quantity / 10) AS INT) AS line, l_linenumber * 1000000 + l_partkey AS word_no, concat('w', l_partkey) AS word, CAST(l_suppkey % 51 * 2 - 1 AS DOUBLE) AS confidence FROM lineitem"


def tokens(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(WORDS)


def ocr_lines(spark, sf_dir):
    return lines.ocr_lines(tokens(spark, sf_dir))


def ocr_confidence(spark, sf_dir):
    return lines.ocr_confidence(lines.ocr_lines(tokens(spark, sf_dir)))


def routed_lines(spark, sf_dir):
    """Lines of documents by their text layer: from spans where there is one, else from recognised words, with a warning."""
    few = text_layer(spark, sf_dir)
    made = tokens(spark, sf_dir)
    from_spans = made.select("doc_id", F.col("word_no").alias("place"), F.col("word").alias("line"))
    read = lines.ocr_lines(made).select("doc_id", (F.col("block") * 1000 + F.col("line")).cast("long").alias("place"), F.col("text").alias("line"))
    return lines.routed(few, from_spans, read)


PARTS = "SELECT o_custkey AS doc_id, o_orderkey AS spot, CASE o_orderkey % 7 WHEN 0 THEN 'footer' WHEN 1 THEN 'table' WHEN 2 THEN 'header' WHEN 3 THEN 'table' ELSE 'body' END AS source, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat(' ', o_orderpriority, ' ', o_orderkey) END AS text FROM orders"


def assembled_lines(spark, sf_dir):
    """Lines of parts of documents: body, then tables, then headers and footers."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return lines.assembled(spark.sql(PARTS))


COLUMNS = f"""s AS (SELECT DISTINCT * FROM ({SPANS})), g AS (SELECT *, lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) AS b FROM s),
  gap AS (SELECT doc_id, page, (x0 + b) / 2 AS mid FROM g WHERE x0 - b >= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY x0 - b DESC, x0) = 1),
  shares AS (SELECT s.doc_id, s.page, any_value(mid) AS mid, avg((x0 >= mid)::INT) AS share FROM s LEFT JOIN gap USING (doc_id, page) GROUP BY ALL),
  cols AS (SELECT doc_id, page, CAST(CASE WHEN mid IS NOT NULL AND share >= 0.15 THEN 2 ELSE 1 END AS BIGINT) AS n_columns, CASE WHEN mid IS NOT NULL AND share >= 0.15 THEN mid END AS split_at FROM shares)"""
ORDERED = f"""{COLUMNS}, ordered AS (SELECT doc_id, page, x0, y0, text, CAST(coalesce(x0 >= split_at, false)::INT AS BIGINT) AS column_, row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(x0 >= split_at, false)::INT, y0, x0, text) AS place FROM s JOIN cols USING (doc_id, page))"""
OCR = f"ocr AS (SELECT doc_id, page, block, paragraph, line, string_agg(word, ' ' ORDER BY word_no, word) AS text, round(avg(greatest(confidence, 0)), 1) AS mean_confidence FROM ({WORDS}) GROUP BY ALL)"
LAYER = "layer AS (SELECT l_orderkey AS doc_id, sum(length(trim('  ' || l_returnflag || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' '))) > 20 AS has_text FROM lineitem GROUP BY ALL)"
SQL = {
    "stream_dedupe": "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
    "stream_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_change_feed": "SELECT user_id, event_type, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) WHERE NOT coalesce(event_type = 'error' AND value < 2, false)",
    "stream_streaks": """WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM days),
        r AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS run FROM g), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY day) AS streak FROM r)
        SELECT user_id, CAST(day AS VARCHAR) AS day, streak, max(streak) OVER (PARTITION BY user_id ORDER BY day) AS longest, CASE WHEN gap > 1 THEN 'reset' ELSE 'incremented' END AS action, CASE WHEN streak IN (3, 7, 30) THEN streak END AS milestone FROM s""",
    "stream_frames": """SELECT user_id AS conn, row_number() OVER w AS frame_no, props AS data, CAST(sum(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)) OVER w AS BIGINT) AS total FROM events WHERE props IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "page_columns": f"WITH {COLUMNS} SELECT * FROM cols",
    "max_columns": f"WITH {COLUMNS} SELECT doc_id, max(n_columns) AS n_columns FROM cols GROUP BY doc_id",
    "reading_order": f'WITH {ORDERED} SELECT doc_id, place, page, column_ AS "column", text FROM ordered',
    "span_lines": f"""WITH {ORDERED}, k AS (SELECT *, floor((y0 - 100) / 12) AS band FROM ordered), n AS (SELECT *, CASE WHEN band = lag(band) OVER (PARTITION BY doc_id ORDER BY place) THEN 0 ELSE 1 END AS new FROM k),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) - 1 AS line_no FROM n) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, string_agg(text, ' ' ORDER BY x0, place) AS line FROM r GROUP BY doc_id, line_no""",
    "text_layer": f"WITH {LAYER} SELECT * FROM layer",
    "ocr_lines": f"WITH {OCR} SELECT * FROM ocr",
    "ocr_confidence": f"WITH {OCR} SELECT doc_id, coalesce(floor((2 * sum(CAST(round(mean_confidence * 10) AS BIGINT)) + count(*)) / (2 * count(*))) / 10, 0) AS confidence FROM ocr GROUP BY doc_id",
    "routed_lines": f"""WITH {OCR}, {LAYER} SELECT doc_id, place, line, CAST(NULL AS VARCHAR) AS warning FROM (SELECT doc_id, word_no AS place, word AS line FROM ({WORDS})) JOIN layer USING (doc_id) WHERE has_text
        UNION ALL SELECT doc_id, CAST(block * 1000 + line AS BIGINT), text, 'read by OCR' FROM ocr JOIN layer USING (doc_id) WHERE NOT has_text""",
    "assembled_lines": f"""WITH p AS (SELECT * FROM ({PARTS}) WHERE trim(text) <> '') SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE source WHEN 'body' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, spot) - 1 AS line_no, trim(text) AS line,
        count(*) FILTER (WHERE source = 'table') OVER (PARTITION BY doc_id) AS n_table_lines FROM p""",
}
QUERIES = {name: globals()[name] for name in SQL}

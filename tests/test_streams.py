"""Streams in several batches against their batch twins, and what they do with late rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from careerlake.operators import activity, lines
from careerlake.streaming import streams

DDL = "event_id long, ts timestamp, user_id long, event_type string"
T0 = dt.datetime(2024, 1, 1, 10)


def at(days, hours=0):
    return T0 + dt.timedelta(days=days, hours=hours)


@pytest.fixture()
def stream(spark, tmp_path):
    def made(batches, ddl=DDL):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return streams.arriving(spark, str(tmp_path / "in"), "*.parquet", ddl, at_once=1)

    return made


def test_streaks_over_batches(spark, stream):
    batches = [[(1, at(0), 7, "a"), (2, at(1), 7, "a"), (3, at(0), 8, "a")], [(4, at(2), 7, "a"), (5, at(2, 1), 7, "b"), (6, at(5), 7, "a")], [(7, at(6), 7, "a"), (8, at(1), 8, "a")]]
    got = streams.run(streams.streaks(stream(batches)))
    days = spark.createDataFrame([r for b in batches for r in b], DDL).select("user_id", F.to_date("ts").alias("day")).distinct()
    want = activity.streak_states(days)
    key = lambda df: sorted(map(tuple, df.select("user_id", "day", "streak", "longest", "action", "milestone").collect()), key=repr)
    assert key(got) == key(want) and got.select("batch").distinct().count() == 3


STATE = ("user_id", "day", "streak", "longest", "action", "milestone")


def states_of(df):
    return sorted(map(tuple, df.select(*STATE).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_streaks_in_any_order_of_days(spark, stream, seed):
    r = random.Random(seed)
    rows = [(k, at(r.randrange(40), r.randrange(12)), r.choice([7, 8, None]), "a") for k in range(70)] + [(99, None, 7, "a")]
    r.shuffle(rows)
    batches = [rows[k::7] for k in range(7)]
    got = streams.run(streams.streaks(stream(batches)))
    days = spark.createDataFrame(rows, DDL).filter("ts IS NOT NULL").select("user_id", F.to_date("ts").alias("day")).distinct()
    assert states_of(streams.newest(got, "user_id", "day")) == states_of(activity.streak_states(days))


def test_late_day_joins_two_runs_and_corrects_them(stream):
    batches = [[(1, at(0), 7, "a"), (2, at(1), 7, "a"), (3, at(3), 7, "a"), (4, at(4), 7, "a"), (5, at(9), 7, "a")], [(6, at(2), 7, "a"), (7, at(0), 7, "a")], [(8, at(2), 7, "a")]]
    written = streams.run(streams.streaks(stream(batches)))
    day = lambda n: at(n).date()
    assert set(states_of(written.filter("batch = 1"))) == {
        (7, day(2), 3, 3, "incremented", 3), (7, day(3), 4, 4, "incremented", None), (7, day(4), 5, 5, "incremented", None), (7, day(9), 1, 5, "reset", None),
    }
    assert written.filter("batch = 2").count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_days(seed):
    r = random.Random(seed)
    have, more = {r.randrange(30) for _ in range(r.randrange(20))}, {r.randrange(30) for _ in range(r.randrange(9))}
    runs = streams.merged(streams.merged([], sorted(have)), sorted(more))
    assert [d for a, b in runs for d in range(a, b + 1)] == sorted(have | more) and all(b + 1 < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_latest_is_kept_up(stream):
    batches = [[(1, at(0), 7, "a"), (2, at(0), 8, "b")], [(3, at(2), 7, "c")], [(4, at(1), 7, "d"), (5, at(2), 7, "e")]]
    out = streams.run(streams.latest(stream(batches), "user_id", "event_id", ["event_id", "event_type"]), "update")
    assert sorted(map(tuple, streams.newest(out, "user_id").collect())) == [(7, 5, "e"), (8, 2, "b")]


def test_one_a_day(stream):
    batches = [[(1, at(0), 7, "a"), (2, at(0, 2), 7, "a")], [(3, at(0, 5), 7, "a"), (4, at(1), 7, "a")], [(5, at(1), 7, "b"), (6, at(0, 3), 7, "a")]]
    out = streams.run(streams.once_a_day(stream(batches), ["user_id", "event_type"]))
    assert sorted((r["user_id"], r["event_type"], r["day"].day) for r in out.collect()) == [(7, "a", 1), (7, "a", 2), (7, "b", 2)]


CHUNKS = "conn long, seq long, ts timestamp, chunk string"


def test_frames_across_batches(stream):
    batches = [[(1, 0, at(0), 'data: {"k": 1}\n'), (1, 1, at(0), '\ndata: {"k"'), (2, 0, at(0), 'data: {"k": 5}\n\n')], [(1, 2, at(0), ": 2}\n\nda")], [(1, 3, at(0), 'ta: {"k": 3}\n\n'), (2, 1, at(0), "data: {")]]
    out = streams.run(streams.frames(stream(batches, CHUNKS)))
    assert sorted(map(tuple, out.drop("batch").collect())) == [(1, 1, '{"k": 1}', 1), (1, 2, '{"k": 2}', 3), (1, 3, '{"k": 3}', 6), (2, 1, '{"k": 5}', 5)]


def test_odd_chunks(stream):
    end = '{"k": 1}\n'
    batches = [[(None, 0, at(0), "data: "), (None, 1, at(0), None), (None, 2, at(0), ""), (None, 3, at(0), end)], [(None, None, at(0), "x"), (None, 9, None, "y"), (None, 4, at(0), "\n")], [(None, 5, at(0), end + "\n" + end + "\n\n" * 0)]]
    assert [tuple(r)[:4] for r in streams.run(streams.frames(stream(batches, CHUNKS))).orderBy("frame_no").collect()] == [(None, 1, '{"k": 1}', 1), (None, 2, '{"k": 1}', 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_cut_anywhere(stream, seed):
    r = random.Random(seed)
    frames = {c: [{"k": r.randrange(9), "pad": "x" * r.randrange(20)} for _ in range(12)] for c in (1, 2)}
    pieces = []
    for c, whole in frames.items():
        text, seq = "".join(f"data: {json.dumps(f)}\n\n" for f in whole), 0
        while text:
            n = r.randrange(1, 15)
            pieces.append((c, seq, at(0, seq % 3), text[:n]))
            text, seq = text[n:], seq + 1
    pieces.sort(key=lambda p: p[1])
    batches = [pieces[k : k + 30] for k in range(0, len(pieces), 30)]
    for b in batches:
        r.shuffle(b)
    got = streams.run(streams.frames(stream(batches, CHUNKS))).orderBy("conn", "frame_no").collect()
    want = [(c, i + 1, json.dumps(f), sum(g["k"] for g in whole[: i + 1])) for c, whole in frames.items() for i, f in enumerate(whole)]
    assert [tuple(g)[:4] for g in got] == want


def test_abandoned_connections_are_closed(spark, stream):
    """Each day another connection speaks and never ends its frame: states stay as many as a watermark's span has, and connection 0 begins anew."""
    open_ = [[(c, 0, at(3 * c), 'data: {"k": 1}\n\ndata: {"k"')] for c in range(6)]
    last = [[(0, 1, at(18), 'data: {"k": 7}\n\n'), (5, 1, at(17), ": 4}\n\n")]]
    path = f"{streams.shared(spark)}/open-{random.randrange(10**9)}"
    query = streams.frames(stream(open_ + last, CHUNKS)).writeStream.outputMode("append").format("memory").queryName("open_frames").trigger(availableNow=True)
    query.option("checkpointLocation", path).start().awaitTermination()
    assert sorted(map(tuple, spark.table("open_frames").collect())) == [(0, 1, '{"k": 1}', 1), (0, 1, '{"k": 7}', 7)] + [(c, 1, '{"k": 1}', 1) for c in range(1, 6)] + [(5, 2, '{"k": 4}', 5)]
    left = lambda var, **o: sorted(r["conn"] for r in spark.read.format("statestore").options(stateVarName=var, **o).load(path).select("key.conn").collect())
    assert left("counts") == [0, 5] and left("held", flattenCollectionTypes="true") == []


def test_two_columns_are_read_one_after_the_other(spark):
    left = [(1, 0, 50.0, 100.0 + 20 * k, f"L{k}") for k in range(5)]
    right = [(1, 0, 320.0, 100.0 + 20 * k, f"R{k}") for k in range(5)]
    spans = spark.createDataFrame(left + right + [(1, 0, 80.0, 102.5, "and"), (2, 0, 50.0, 0.0, "one")], "doc_id long, page int, x0 double, y0 double, text string")
    columns = lines.page_columns(spans, spans.select("doc_id", "page").distinct())
    assert {(r["doc_id"], r["n_columns"]) for r in columns.collect()} == {(1, 2), (2, 1)}
    read = lines.span_lines(lines.reading_order(spans, columns)).orderBy("doc_id", "line_no").collect()
    assert [r["line"] for r in read] == ["L0 and", "L1", "L2", "L3", "L4", "R0", "R1", "R2", "R3", "R4", "one"]


def test_height_of_the_first_span_counts(spark):
    spans = spark.createDataFrame([(1, 0, 10.0 + k, 100.0 + 2 * k, f"s{k}") for k in range(5)], "doc_id long, page int, x0 double, y0 double, text string")
    columns = lines.page_columns(spans, spans.select("doc_id", "page").distinct())
    assert [r["line"] for r in lines.span_lines(lines.reading_order(spans, columns)).orderBy("line_no").collect()] == ["s0 s1", "s2 s3", "s4"]

"""The table of newest rows against a plain dictionary; batches run again, merges, deletes, lost writes, and its plan."""

import random
import uuid

import pytest

from careerlake.sources.keyed import KeyedTable
from careerlake.sources.tables import shared
from careerlake.streaming import streams

DDL = "id long, `a.b` string, ts long, n long, value double"
NAMES = ("id", "a.b", "ts", "n", "value")


@pytest.fixture()
def keyed(spark):
    def made(order=("ts", "n")):
        return KeyedTable(spark, f"{shared(spark)}/keyed-{uuid.uuid4().hex}", DDL, ("id", "a.b"), order)

    return made


def rows_of(t):
    return sorted(map(tuple, t.read().collect()), key=repr)


def change(r, n):
    return (r.choice([None, *range(12)]), r.choice(["x", None]), r.choice([None, *range(30)]), n, float(n) if n % 5 else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_give_the_newest_rows(spark, keyed, seed):
    r, t, want, n = random.Random(seed), keyed(), {}, 0
    for batch in range(7):
        rows = [change(r, n + k) for k in range(r.choice([0, 3, 25]))]
        n += len(rows)
        gone = {row[3] for row in rows if r.random() < 0.3}
        df = spark.createDataFrame([(*row, "more", row[3] in gone) for row in rows], f"{DDL}, other string, away boolean")
        assert t.apply(df, batch, df["away"])
        if r.random() < 0.5:
            before = rows_of(t)
            assert not t.apply(df, batch, df["away"]) and rows_of(t) == before  # run again
        if batch in (2, 5):
            t.merge()
        for row in rows:
            rank = (row[2] is not None, row[2] or 0, row[3])
            if row[:2] not in want or want[row[:2]][0] < rank:
                want[row[:2]] = (rank, row if row[3] not in gone else None)
        assert rows_of(t) == sorted((v for _, v in want.values() if v), key=repr)


def test_equal_order_takes_the_later_batch(spark, keyed):
    t = keyed(("ts",))
    for batch, value in enumerate((1.0, 2.0, 3.0)):
        t.apply(spark.createDataFrame([(1, "x", 5, 0, value)], DDL), batch)
        t.merge() if batch == 1 else None
    assert rows_of(t) == [(1, "x", 5, 0, 3.0)]


def test_empty_table(keyed):
    t = keyed()
    t.merge()
    assert rows_of(t) == [] and t.read().columns == list(NAMES)


def test_what_is_not_logged_is_not_read(spark, keyed, monkeypatch):
    t = keyed()
    t.apply(spark.createDataFrame([(1, "x", 5, 0, 1.0)], DDL), 0)
    two = spark.createDataFrame([(1, "x", 6, 1, 2.0), (2, "x", 6, 1, 2.0)], DDL)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_note", lost)
        with pytest.raises(RuntimeError):
            t.apply(two, 1)
        with pytest.raises(RuntimeError):
            t.merge()
    assert rows_of(t) == [(1, "x", 5, 0, 1.0)]
    assert t.apply(two, 1) and len(rows_of(t)) == 2


def test_reads_base_and_open_deltas_without_shuffling_the_base(spark, keyed):
    t = keyed()
    t.apply(spark.range(5000).selectExpr("id", "'x' AS `a.b`", "1L AS ts", "id AS n", "0.0D AS value"), 0)
    t.merge()
    t.apply(spark.createDataFrame([(3, "x", 2, 0, 9.0)], DDL), 1)
    base, deltas = t.open()
    df = t.read()
    read = {f.split("/")[-2] for f in df.inputFiles()}
    assert read == {base, *deltas} and len(deltas) == 1
    assert df.filter("value = 9").count() == 1 and df.count() == 5000
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0]


def test_a_stream_keeps_it_up(spark, keyed, tmp_path):
    r, t = random.Random(5), keyed()
    rows = [change(r, k) for k in range(90)]
    for k in range(0, 90, 10):
        spark.createDataFrame(rows[k : k + 10], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.arriving(spark, str(tmp_path / "in"), "*.parquet", DDL, at_once=1)
    streams.into(stream, t, stream["n"] % 7 == 0, merge_after=4)
    want = {}
    for row in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[3])):
        want[row[:2]] = row
    assert rows_of(t) == sorted((v for v in want.values() if v[3] % 7), key=repr)
    log = t.log()
    assert [x["kind"] for x in log].count("base") == 2 and len(t.open()[1]) == 1

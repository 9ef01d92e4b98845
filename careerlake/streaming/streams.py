"""Streams of events: once a day, latest by key, streak states, frames put together from chunks.

Each takes a streaming DataFrame; run() drives one to its end and gives what it wrote. Event time is `ts`; a row more than LATE behind
the newest one may be dropped by once_a_day() and frames(), which alone forget. States are a few numbers a key, and the text of an unended frame.
"""

from __future__ import annotations

import datetime as dt
import heapq
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from careerlake.sources.keyed import KeyedTable
from careerlake.sources.tables import shared, ship

LATE = "1 day"
#: After so long a connection counts as abandoned.
IDLE = dt.timedelta(hours=1)
FRAME_END, PREFIX = "\n\n", "data: "


def arriving(spark: SparkSession, folder: str, files: str, ddl: str, at_once: int | None = None) -> DataFrame:
    """Rows of Parquet files as they come to a folder; at_once: files in a batch."""
    reader = ship(spark).readStream.schema(ddl).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(folder)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream writes until no row is left, with the number of the batch in `batch`."""
    path = f"{shared(stream.sparkSession)}/streams/{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        # a batch that is run again replaces its own rows
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{path}/out")


def into(stream: DataFrame, kept: KeyedTable, gone: Column | None = None, merge_after: int = 20) -> KeyedTable:
    """Takes the stream's rows into a table of the newest row of each key until no row is left; rows where `gone` holds delete their key.

    Where the stream goes on is kept beside the table, so that a batch run again after a failure has its old number, which the table knows.
    """
    ship(stream.sparkSession)
    query = stream.writeStream.option("checkpointLocation", f"{kept.path}/state").trigger(availableNow=True).foreachBatch(kept.taker(gone, merge_after)).start()
    query.awaitTermination()
    return kept


def once_a_day(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row to arrive of each key and day."""
    day = F.to_date("ts").alias("day")
    return events.withWatermark("ts", LATE).select(*keys, day, "ts").dropDuplicatesWithinWatermark([*keys, "day"])


def latest(events: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest row of each key so far, later tie first; to be run in update mode and read by newest()."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("ts", tie)).alias("r")).select(key, "r.*")


def newest(written: DataFrame, *keys: str) -> DataFrame:
    """Of the rows that update mode or corrections wrote the last of each key."""
    columns = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


Runs = list[tuple[int, int]]


def merged(runs: Runs, days: list[int]) -> Runs:
    """Runs of days with more days, both in order: days that touch a run lengthen it, and one between two joins them."""
    out: Runs = []
    for a, b in heapq.merge(runs, ((d, d) for d in days)):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def states(runs: Runs, since: int) -> dict[int, tuple[int, int, str]]:
    """streak, longest, action after each day of the runs from `since` on."""
    out, longest = {}, 0
    for k, (a, b) in enumerate(runs):
        for d in range(max(a, since), b + 1):
            out[d] = (d - a + 1, max(longest, d - a + 1), "reset" if k and d == a else "incremented")
        longest = max(longest, b - a + 1)
    return out


def streaks(events: DataFrame, user: str = "user_id") -> DataFrame:
    """The state after each day of a user: streak, longest, action, milestone. Days may come in any order.

    A day that comes late changes the days after it, so a day may be written again in a later batch: newest(..., "user_id", "day") gives what
    holds. Only days whose state changes are written, so days in order are written once. What is kept of a user are the first and last days
    of the runs, not the days. Rows without a time are passed over; no user is a user as well.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before: Runs = list(zip(*state.get)) if state.exists else []
        days = sorted({d.toordinal() for f in frames for d in f["day"]})
        after, rows = merged(before, days), []
        if after != before:
            old = states(before, days[0])
            rows = [(key[0], dt.date.fromordinal(d), *s, s[0] if s[0] in (3, 7, 30) else None) for d, s in states(after, days[0]).items() if old.get(d) != s]
            state.update(([a for a, _ in after], [b for _, b in after]))
        yield pd.DataFrame(rows, columns=["user_id", "day", "streak", "longest", "action", "milestone"]).astype({"milestone": "Int64"})

    ship(events.sparkSession)
    days = events.select(F.col(user).alias("user_id"), F.to_date("ts").alias("day")).filter("day IS NOT NULL")
    out = "user_id long, day date, streak long, longest long, action string, milestone long"
    return days.groupBy("user_id").applyInPandasWithState(step, out, "firsts array<int>, lasts array<int>", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frames(chunks: DataFrame, idle: dt.timedelta = IDLE, late: str = LATE) -> DataFrame:
    """Whole frames of (conn, seq, ts, chunk): conn, frame_no, data, total (of `k` in the frames so far). What has no end yet waits for its rest.

    A connection of which nothing newer than `idle` before the watermark (`late` behind the newest chunk) has come is closed by a timer: its
    counts and what it holds of an unended frame are forgotten, and nothing is written of them. A chunk that comes after that begins a
    connection anew, with frame 1. Chunks older than the watermark are passed over; empty and null chunks and those without a time or a number add nothing.
    No connection is one as well. Pieces of an unended frame are a list in the state, which is added to and not written anew at each
    chunk. The session's state store is set to RocksDB, which timers and lists need; states then lie on disk, not in the heap.
    """
    millis, end, prefix = int(idle.total_seconds() * 1000), FRAME_END, PREFIX

    # made here, so that it is sent by value: the worker that asks it for its states has no library yet
    class Frames(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counts = handle.getValueState("counts", "n long, total long, seen long, tail string")
            self.held = handle.getListState("held", "chunk string")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            n, total, seen, tail = self.counts.get() or (0, 0, None, "")
            before, new, out = seen, [], []
            waiting = bool(tail)
            for r in pd.concat(list(rows)).sort_values("seq").itertuples():
                seen = r.at if seen is None else max(seen, r.at)
                new.append(r.chunk)
                if end not in tail + r.chunk:
                    tail = (tail + r.chunk)[1 - len(end) :]
                    continue
                if waiting:
                    # the state is asked once a batch, at the first end of a frame, and not at each
                    new = [*(c for (c,) in self.held.get()), *new]
                    self.held.clear()
                    waiting = False
                *done, tail = "".join(new).split(end)
                for frame in done:
                    data = frame.removeprefix(prefix)
                    n, total = n + 1, total + int(json.loads(data).get("k", 0))
                    out.append((key[0], n, data, total))
                new = [tail] if tail else []
                tail = tail[1 - len(end) :]
            if new:
                self.held.appendList([(c,) for c in new])
            self.counts.update((n, total, seen, tail))
            if seen != before:
                if before is not None:
                    self.handle.deleteTimer(before + millis)
                self.handle.registerTimer(seen + millis)
            yield pd.DataFrame(out, columns=["conn", "frame_no", "data", "total"])

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.counts.clear()
            self.held.clear()
            yield pd.DataFrame([], columns=["conn", "frame_no", "data", "total"])

        def close(self) -> None:
            pass

    spark = ship(chunks.sparkSession)
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = chunks.withWatermark("ts", late).filter("chunk <> '' AND seq IS NOT NULL AND ts IS NOT NULL").select("conn", "seq", "ts", F.unix_millis("ts").alias("at"), "chunk")
    return rows.groupBy("conn").transformWithStateInPandas(Frames(), "conn long, frame_no long, data string, total long", "append", "eventTime")

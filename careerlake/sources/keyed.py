"""A table of the newest row of each key, kept up by batches of changes: a base, deltas not yet merged into it, and a log of both.

The folder holds `log` (a row for each batch taken in or merge made), `base-*` and `delta-*`. A write counts only once its row stands in
the log, which is one Parquet append: what a lost job left behind is never read. A batch whose number the log has is passed over, so
batches may be run again. Reading takes the base and the open deltas; the base is filtered by the deltas' keys, not grouped or shuffled, as
long as these keys are few enough for Spark to broadcast. One writer at a time; readers any number, each sees a whole state.

Of a key the row with the greatest `order` holds, among equals that of the later batch, in a batch any (give an order that has none). A
deleted key stays in the base as a row of nulls, so that an older change that comes late doesn't bring it back. Null is a key as well. A
null order is before all others. An empty batch is logged, and nothing else. Columns may have any names but `__batch` and `__gone`.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "at long, kind string, batch long, folder string"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclasses.dataclass(frozen=True)
class KeyedTable:
    """keys, order: names of columns; ddl: all columns."""

    spark: SparkSession
    path: str
    ddl: str
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def log(self) -> list:
        """Rows of the log in order, one for each batch and each merge."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("at").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _note(self, kind: str, batch: int, folder: str | None, at: int) -> None:
        self.spark.createDataFrame([(at, kind, batch, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _rows(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(f"{self.ddl}, __batch long, __gone boolean").parquet(*(f"{self.path}/{f}" for f in folders))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rank = F.struct(*map(quoted, self.order), F.col("__batch"))
        # grouped by a struct, so that names of columns can't clash with those of aggregates
        return rows.groupBy(F.struct(*map(quoted, self.keys)).alias("__key")).agg(F.max_by(F.struct("*"), rank).alias("__row")).select("__row.*")

    def apply(self, changes: DataFrame, batch: int, gone: Column | None = None) -> bool:
        """Takes in the changes as batch number `batch`; rows where `gone` holds delete their key. False if the log has the batch already."""
        log = self.log()
        if any(r["kind"] == "delta" and r["batch"] == batch for r in log):
            return False
        names = self.spark.createDataFrame([], self.ddl).columns
        deleted = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
        kept = {*self.keys, *self.order}
        rows = changes.withColumn("__gone", deleted)
        rows = rows.select(*(quoted(c) if c in kept else F.when(~F.col("__gone"), quoted(c)).alias(c) for c in names), F.lit(batch).cast("long").alias("__batch"), "__gone")
        folder = f"delta-{uuid.uuid4().hex}"
        self._newest(rows).write.parquet(f"{self.path}/{folder}")
        self._note("delta", batch, folder, len(log))
        return True

    def open(self) -> tuple[str | None, list[str]]:
        """Folders that hold the table now: base, and the deltas behind it."""
        base, deltas = None, []
        for r in self.log():
            base, deltas = (r["folder"], []) if r["kind"] == "base" else (base, [*deltas, r["folder"]])
        return base, deltas

    def _merged(self, base: str | None, deltas: list[str]) -> DataFrame:
        if not deltas:
            return self._rows(base) if base else self.spark.createDataFrame([], f"{self.ddl}, __batch long, __gone boolean")
        changed = self._newest(self._rows(*deltas))
        if not base:
            return changed
        old, new = self._rows(base).alias("o"), changed.select(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(self.keys)))
        on = F.lit(True)
        for i, k in enumerate(self.keys):
            on = on & F.col(f"o.`{k}`").eqNullSafe(F.col(f"__k{i}"))
        # rows of the base that change are as few as the deltas': these alone are grouped
        touched = old.join(new, on, "left_semi").unionByName(changed)
        return old.join(new, on, "left_anti").unionByName(self._newest(touched))

    def read(self) -> DataFrame:
        return self._merged(*self.open()).filter("NOT __gone").drop("__batch", "__gone")

    def merge(self) -> None:
        """Makes base and open deltas the new base. Folders it replaces stay for those who still read them."""
        log = self.log()
        base, deltas = self.open()
        if deltas:
            folder = f"base-{uuid.uuid4().hex}"
            self._merged(base, deltas).write.parquet(f"{self.path}/{folder}")
            self._note("base", max(r["batch"] for r in log), folder, len(log))

    def taker(self, gone: Column | None = None, merge_after: int = 20) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: takes in each batch, and merges as soon as so many deltas are open."""

        def take(rows: DataFrame, batch: int) -> None:
            self.apply(rows, batch, gone)
            if len(self.open()[1]) >= merge_after:
                self.merge()

        return take

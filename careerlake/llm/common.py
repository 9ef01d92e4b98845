"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.sources.tables import ship

#: Rows that a Python task holds as objects at a time; Arrow batches are cut to this.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as the session names it; a folder of one machine would not do, so there is no other."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        raise ValueError("spark.checkpoint.dir isn't set: name a folder there that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a table of columns in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def by_text(
    df: DataFrame, schema: pa.Schema, ddl: str, fn: Callable[[list[str]], list[tuple]], keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The columns in keep, and those that fn makes from each text (null: empty), one tuple a row.

    schema and ddl describe the made columns. Partitions are those of df: no shuffle.
    """
    ship(df.sparkSession)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                rows = fn(part.column(len(keep)).to_pylist())
                made = [pa.array(list(values), type=f.type) for values, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=[*keep, *schema.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, {ddl}" if kept else ddl)


#: A key with more than this share of the rows of a join is dealt out; so many keys are that at most.
DEALT_SHARE = 1 / 200


def dealt_join(big: DataFrame, small: DataFrame, keys: list[str], least: int = 10_000, counts: DataFrame | None = None) -> DataFrame:
    """The inner join of big with small, which has a row for each key; n, the rows of big with a key, is in small (and isn't kept), or with the keys in counts.

    Rows of keys with over `least` rows and DEALT_SHARE of all are dealt to as many tasks as there are such shares in them, so that no
    key, however common, is one task's. These keys, at most 1 / DEALT_SHARE, are broadcast to tell them. Null keys find nothing.
    """
    if counts is None:
        counts, small = small.select(*keys, "n"), small.drop("n")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    share = max(int((total or 0) * DEALT_SHARE), least)
    if (most or 0) <= share:
        return big.join(small, keys)
    hot = F.broadcast(counts.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = big.join(hot, keys, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    copies = small.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


def ascii_lower(column) -> F.Column:
    """Lower-case A-Z alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

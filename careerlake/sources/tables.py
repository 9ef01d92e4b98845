"""Tables as Parquet in a folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the library's code, once a session, to where Python tasks run, so that it need not be installed there.

    Spark serves the archive from the driver, as it does any file of addPyFile(); executors never look for the driver's path.
    """
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_careerlake", None) is None:
        archive = f"{tempfile.mkdtemp(prefix='careerlake-')}/careerlake.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, file.relative_to(top.parent))
        context.addPyFile(archive)
        context._careerlake = archive
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        raise ValueError("spark.checkpoint.dir isn't set: name a folder there that driver and executors share")
    return given


def stored(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder; survives lost executors."""
    path = f"{shared(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df on all cores where its files give fewer tasks than these, as a small table of one row group does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

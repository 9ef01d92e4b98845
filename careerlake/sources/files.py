"""Sources and sinks besides the tables: texts, labelled lists in CSV, stored reports, fetched pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.operators import guard

LEAST, PAGE_CHARS, KEPT_CHARS = 80, 200_000, 3000


def readable(text: Column) -> Column:
    """A text with single blanks; null where at most LEAST characters are left."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) > LEAST, plain)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of the files of a folder, whole, those with enough text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), readable(F.col("value")).alias("text")).filter("text IS NOT NULL")


def labelled_list(spark: SparkSession, path: str, category: str = "hard") -> DataFrame:
    """canonical, category, synonyms of a CSV with preferredLabel and, a line each, altLabels; rows without a label go."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    name = F.trim("preferredLabel")
    other = F.filter(F.transform(F.split(F.coalesce("altLabels", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.filter(name != "").select(name.alias("canonical"), F.lit(category).alias("category"), other.alias("synonyms"))


def save_reports(reports: DataFrame, path: str) -> None:
    """Appends rows with an id and the moment; each is kept as JSON beside its score."""
    made = reports.select(F.uuid().alias("id"), F.current_timestamp().alias("created_at"), "overall", F.to_json(F.struct("*")).alias("report"))
    made.write.mode("append").parquet(path)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def page_source(pages: DataFrame) -> DataFrame:
    """title, description and the first KEPT_CHARS of the text of fetched pages: public address, a page by its type, enough to read."""
    fit = pages.filter(guard.public_url(F.col("url")) & F.col("content_type").rlike("(?i)text/html|text/plain|application/xhtml"))
    found = fit.select("page_id", *(c.alias(n) for n, c in guard.page_text(F.substring("html", 1, PAGE_CHARS)).items()))
    return found.filter((F.length("text") >= LEAST) | (F.coalesce("description", F.lit("")) != "")).withColumn("text", F.substring("text", 1, KEPT_CHARS))


def new_path(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"

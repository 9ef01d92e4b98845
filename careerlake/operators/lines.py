"""Texts as ordered lines, from texts and from positioned spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careerlake.conf import DEFAULT, Conf


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line, numbered from 0. A null text has one empty line."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def split_pages(spans: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """Spans with `split_at` of their page, null where it has one column: windows of a page, so that spans by document are neither joined nor shuffled again."""
    page = Window.partitionBy("doc_id", "page")
    gaps = spans.withColumn("before", F.lag("x0").over(page.orderBy("x0"))).withColumn("gap", F.col("x0") - F.col("before"))
    wide = F.col("gap") >= conf.column_gap
    # of equal gaps the leftmost
    split = F.max_by(F.when(wide, (F.col("x0") + F.col("before")) / 2), F.when(wide, F.struct("gap", (-F.col("x0")).alias("left"))))
    found = gaps.withColumn("mid", split.over(page)).withColumn("share", F.avg((F.col("x0") >= F.col("mid")).cast("double")).over(page))
    # a page without a number, or of no document, isn't told from others, so it has no columns
    two = F.col("mid").isNotNull() & (F.col("share") >= conf.column_share) & F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    return found.select(*spans.columns, F.when(two, F.col("mid")).alias("split_at"))


def page_columns(spans: DataFrame, pages: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """doc_id, page, n_columns, split_at: a page has two columns if the widest gap between left edges is wide enough and enough lies right of it."""
    found = split_pages(spans, conf).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.max("split_at").alias("split_at"))
    out = pages.select("doc_id", "page").join(found, ["doc_id", "page"], "left")
    return out.select("doc_id", "page", F.when(F.col("n").isNull(), 0).when(F.col("split_at").isNotNull(), 2).otherwise(1).cast("long").alias("n_columns"), "split_at")


def placed(split: DataFrame) -> DataFrame:
    """Spans with split_at, with `column` and `place`: by page, column, rounded height, left edge."""
    column = F.when(F.col("split_at").isNotNull() & (F.col("x0") >= F.col("split_at")), 1).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("page", "column", F.bround("y0"), "x0", "text")
    return split.withColumn("column", column).withColumn("place", F.row_number().over(order))


def reading_order(spans: DataFrame, columns: DataFrame) -> DataFrame:
    """Spans placed by the columns given for their pages."""
    return placed(spans.join(columns.select("doc_id", "page", "split_at"), ["doc_id", "page"], "left"))


def span_lines(ordered: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """Lines of spans in reading order: one ends where a span is too far from the height of the line's first span, so drift doesn't add up.

    Where lines begin hangs on where the one before began, so heights alone go through a Python task; each is looked at once.
    """
    far = conf.same_line

    @F.arrow_udf("array<int>")
    def starts(heights: pa.Array) -> pa.Array:
        out = []
        for ys in heights.to_pylist():
            at, first = [], None
            for k, y in enumerate(ys):
                # an unknown height stays in its line; one that isn't a number is far from any
                if k == 0 or (y is not None and first is not None and not abs(y - first) <= far):
                    first = y
                    at.append(k)
            out.append(at)
        return pa.array(out, pa.list_(pa.int32()))

    spans = F.array_sort(F.collect_list(F.struct("place", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), "text")))
    grouped = ordered.groupBy("doc_id").agg(spans.alias("spans")).withColumn("starts", starts(F.col("spans.y0")))
    of_line = lambda at, k: F.slice("spans", at + 1, F.coalesce(F.get("starts", k + 1), F.size("spans")) - at)
    parts = lambda line: F.array_sort(F.transform(line, lambda s: F.struct(s["x0"].alias("x0"), s["place"].alias("place"), s["text"].alias("text"))))
    found = grouped.select("doc_id", F.posexplode(F.transform("starts", lambda at, k: parts(of_line(at, k)))).alias("line_no", "l"))
    return found.select("doc_id", "line_no", F.array_join("l.text", " ").alias("line"))


def ocr_lines(tokens: DataFrame) -> DataFrame:
    """Words grouped to lines with their mean confidence (unknown, -1, counts as 0)."""
    sure = F.greatest(F.col("confidence"), F.lit(0.0))
    grouped = tokens.groupBy("doc_id", "page", "block", "paragraph", "line").agg(
        F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("w"), F.round(F.avg(sure), 1).alias("mean_confidence")
    )
    return grouped.select("doc_id", "page", "block", "paragraph", "line", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), "mean_confidence")


def has_text_layer(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg((F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)) > 20).alias("has_text"))


def ocr_confidence(of_lines: DataFrame) -> DataFrame:
    """Mean of the means of a document's lines, to one place; 0 without any."""
    # in tenths, so that halves are rounded up exactly
    tenths, n = F.sum(F.round(F.col("mean_confidence") * 10).cast("long")), F.count("mean_confidence")
    return of_lines.groupBy("doc_id").agg(F.coalesce(F.floor((2 * tenths + n) / (2 * n)) / 10, F.lit(0.0)).alias("confidence"))


def routed(layers: DataFrame, from_spans: DataFrame, read: DataFrame) -> DataFrame:
    """Lines of documents with a text layer from spans, of others as read, with a warning; all: doc_id and place, line."""
    plain = from_spans.join(layers.filter("has_text").select("doc_id"), "doc_id", "left_semi").withColumn("warning", F.lit(None).cast("string"))
    return plain.unionByName(read.join(layers.filter("NOT has_text").select("doc_id"), "doc_id", "left_semi").withColumn("warning", F.lit("read by OCR")))


def assembled(parts: DataFrame) -> DataFrame:
    """Lines of (doc_id, spot, source, text): body, tables, then headers and footers; blank ones go; with the number of table lines."""
    rank = F.when(F.col("source") == "body", 0).when(F.col("source") == "table", 1).otherwise(2)
    w = Window.partitionBy("doc_id")
    place = F.row_number().over(w.orderBy(rank, "spot")).cast("long") - 1
    full = parts.filter(F.trim("text") != "")
    return full.select("doc_id", place.alias("line_no"), F.trim("text").alias("line"), F.count_if(F.col("source") == "table").over(w).alias("n_table_lines"))

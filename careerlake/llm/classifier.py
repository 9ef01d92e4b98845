"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text, brought to zero mean and unit variance over all documents, go through COMPONENTS cosines of random projections,
which approximate a Gaussian kernel. Each partition sums its part of the normal equations, and a sum by entry adds the parts up; the
totals (COMPONENTS + 2 numbers squared, whatever the corpus) give ridge weights on the driver. Labelled rows left out of that fit calibrate: in bins of raw scores, pooling
adjacent violators makes the share of good labels rise with the score.

Only statistics of the text enter a score. A null text counts as empty and gets a score like any other. Labels with null quality or
null id are not used; several labels of an id all count. Without labels of both classes every score is the share of good ones, or 0.5.
Equal texts get equal scores. Very long texts are read whole, in memory in proportion to their length. Repeated rows stay, row for row.
An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import cut, table
from careerlake.llm.rules import STATS, stats

FOLDS, CALIBRATION_FOLD = 5, 4  # crc32 of the id; fold 0 is held out, fold 4 calibrates
COMPONENTS, WIDTH, RIDGE, SEED, BIN, CUT = 192, 3.0, 1e-2, 11, 0.005, 0.3


def features(rows: pd.DataFrame) -> np.ndarray:
    """A row of features for each row of STATS."""
    v = {c: rows[c].to_numpy(float) for c in STATS}
    words, lines, letters = np.maximum(v["n_words"], 1), np.maximum(v["n_lines"], 1), np.maximum(v["n_letters"], 1)
    columns = [
        np.log1p(v["n_words"]),
        np.minimum(v["word_chars"] / words, 20),
        np.log1p(50 * v["n_symbols"] / words),
        v["n_dup_lines"] / lines,
        v["n_repeat_words"] / words,
        v["n_distinct"] / words,
        np.log1p(v["n_distinct"]) / np.log1p(words),
        v["n_capitals"] / letters,
        np.log1p(50 * v["n_marks"] / words),
        np.minimum(v["n_letters"] / np.maximum(v["word_chars"], 1), 2),
        np.log1p(words / lines),
    ]
    return np.column_stack(columns)


class Cosines:
    """The random features, the same wherever they are made."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.project = draw.normal(size=(len(mean), COMPONENTS)) / WIDTH
        self.phase = draw.uniform(0, 2 * np.pi, COMPONENTS)

    def __call__(self, rows: pd.DataFrame) -> np.ndarray:
        x = ((features(rows) - self.mean) / self.spread).clip(-8, 8)
        z = np.sqrt(2 / COMPONENTS) * np.cos(x @ self.project + self.phase)
        return np.column_stack([z, np.ones(len(z))])


def moments(numbers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the features over all rows, from sums of each partition."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = features(f)
            yield pd.DataFrame({"k": range(x.shape[1]), "n": len(x), "s": x.sum(0), "q": (x**2).sum(0)})

    rows = numbers.select(*STATS).mapInPandas(part, "k int, n long, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("k").collect()
    if not rows:
        size = features(pd.DataFrame({c: [0] for c in STATS})).shape[1]
        return np.zeros(size), np.ones(size)
    n, s, q = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    return s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))


def ridge(labelled: DataFrame, cosines: Cosines) -> np.ndarray | None:
    """Weights that fit quality. Each partition makes one number for each entry of the normal equations, a triangle of them, and Spark adds these up as it does any sum."""
    size = COMPONENTS + 1
    row, column = np.triu_indices(size + 1)  # the last column is the right side

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, n = np.zeros((size + 1, size + 1)), 0
        for f in frames:
            z = np.column_stack([cosines(f), f["quality"].to_numpy(float)])
            a += z.T @ z
            n += len(f)
        if n:
            yield pd.DataFrame({"k": row, "j": column, "v": a[row, column]})

    sums = labelled.mapInPandas(part, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(sums):
        return None
    a = np.zeros((size + 1, size + 1))
    a[sums["k"], sums["j"]] = sums["v"]
    a += np.triu(a, 1).T
    return np.linalg.solve(a[:size, :size] + RIDGE * np.eye(size), a[:size, size])


def pooled(x: list[float], y: list[float], n: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rising means by pooling adjacent violators; x rises. Middles of the blocks and their means."""
    blocks: list[list[float]] = []  # weight, mean, sum of x
    for at, mean, weight in zip(x, y, n):
        blocks.append([weight, mean, weight * at])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, s = blocks.pop()
            b = blocks[-1]
            b[1] = (b[0] * b[1] + w * m) / (b[0] + w)
            b[0], b[2] = b[0] + w, b[2] + s
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] for b in blocks])


def scores(numbers: DataFrame, cosines: Cosines, weights: np.ndarray, keep: list[str]) -> DataFrame:
    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[keep].copy()
            out["raw"] = cosines(f) @ weights if len(f) else np.zeros(0)
            yield out

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in numbers.select(*keep).schema.fields)
    return numbers.select(*dict.fromkeys([*keep, *STATS])).mapInPandas(part, f"{kept}, raw double")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    numbers = cut(stats(docs))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    labelled = numbers.join(known, "doc_id").filter(fold(F.col("doc_id")) != 0)
    cosines = Cosines(*moments(numbers))
    weights = ridge(labelled.filter(fold(F.col("doc_id")) != CALIBRATION_FOLD).select("quality", *STATS), cosines)
    if weights is None:
        weights = np.zeros(COMPONENTS + 1)
    apart = scores(labelled.filter(fold(F.col("doc_id")) == CALIBRATION_FOLD), cosines, weights, ["quality"])
    # raw scores are bounded, and so is the number of bins
    bins = apart.groupBy(F.round(F.col("raw").cast("double") / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("y"), F.avg("raw").alias("x")).orderBy("bin").collect()
    x, y = pooled([r["x"] for r in bins], [r["y"] for r in bins], [r["n"] for r in bins]) if bins else (np.zeros(1), np.full(1, 0.5))

    @F.pandas_udf("double")
    def calibrated(raw: pd.Series) -> pd.Series:
        # between blocks the score rises in a line; a sliver of the raw score orders texts within a block
        return pd.Series((0.999 * np.interp(raw, x, y) + 0.001 * raw.clip(0, 1)).clip(0, 1))

    out = scores(numbers, cosines, weights, ["doc_id"]).withColumn("score", calibrated("raw"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}

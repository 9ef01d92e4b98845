"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells of source, language and topic. The tokens to be expected of the cells are raked in turns to the target marginals of
each of the three, never above the tokens that a cell has, so that a document's probability is its cell's ratio of raked to own tokens and
what is sampled, not only what is weighed, meets the targets. Draws depend on id and seed alone. A value can't give more tokens than it
has: the share of the corpus that is sampled is FRACTION, or ROOM of the most that leaves every target in reach, but LEAST where that is
less. Targets are shares of tokens by value of a dimension; values without one share the rest by the corpus's own shares to the power
EVENNESS, and so do all values of a dimension without targets. Targets of values that the corpus lacks are shared out among the others.
marginals() tells own, target and sampled shares, and which targets are out of reach.

Null sources, languages and texts count as empty; a row with a null id draws as id ''. Repeated ids draw alike; repeated rows stay. Cells
without tokens keep probability fraction. A draw equal to the probability isn't sampled. A very long text counts by its words, in time
in proportion to its length. An empty table gives an empty result. Columns other than doc_id, text, source and lang aren't read, but kept
by sample_mixture.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import cut, dealt_join, table

DIMENSIONS = ("source", "lang", "topic")
#: The first that holds gives a document's topic; a parameter, as RE2 and Java both read it.
TOPICS = {"legal": "(?i)licen[cs]e|copyright", "contact": "@[a-z0-9.-]+[.][a-z]+", "table": " [|] ", "figures": "[0-9]{3,}"}
OTHER = "prose"
#: Target shares are the corpus's own to this power, so that large sources, languages and topics give way to small ones.
EVENNESS = 0.9
ROUNDS, FRACTION, SEED = 12, 0.8, 7
#: Part of the largest fraction that meets the targets, so that raking gets there within ROUNDS; fraction that is sampled whatever the targets.
ROOM, LEAST = 0.95, 0.05
#: Difference of shares up to which a target counts as met.
NEAR = 0.005
#: Cells that may go to the driver (24 MB); more are raked in Spark, by the same steps and to the same weights.
MOST_CELLS = 200_000
#: Shares of tokens by dimension and value.
Targets = dict[str, dict[str, float]]
WORD = "[^\\x20\\x09-\\x0D]+"


def topic(text: Column, topics: dict[str, str]) -> Column:
    out = None
    for name, pattern in topics.items():
        out = out.when(text.rlike(pattern), name) if out is not None else F.when(text.rlike(pattern), name)
    return out.otherwise(OTHER) if out is not None else F.lit(OTHER)


def described(docs: DataFrame, topics: dict[str, str] = TOPICS) -> dict[str, Column]:
    """The cell of a document, its tokens (words) and its draw in 0 to 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 8), 16, 10)
    return {
        "__source": F.coalesce(F.col("source"), F.lit("")),
        "__lang": F.coalesce(F.col("lang"), F.lit("")),
        "__topic": topic(text, topics),
        "__tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "__draw": draw.cast("double") / 2.0**32,
    }


def checked(targets: Targets | None) -> Targets:
    for dimension, shares in (targets or {}).items():
        if dimension not in DIMENSIONS or any(not x >= 0 for x in shares.values()) or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {dimension}: shares of 0 or more, 1 at most together, of {DIMENSIONS}")
    return targets or {}


def goal_shares(own: np.ndarray, given: np.ndarray, evenness: float) -> np.ndarray:
    """Target shares of values: given (nan: none), else what is left by own tokens to the power evenness; 0 without tokens."""
    there, named = own > 0, ~np.isnan(given)
    shares = np.where(there & named, np.nan_to_num(given), 0.0)
    even = np.where(there & ~named, np.where(there, own, 1.0) ** evenness, 0.0)
    if even.sum() > 0:
        shares += even / even.sum() * max(0.0, 1.0 - np.nansum(given))
    return shares / shares.sum() if shares.sum() > 0 else shares


def reachable(most: float, fraction: float) -> float:
    """The fraction to be sampled, where `most` is the largest that no value is short of."""
    return min(fraction, max(ROOM * most, min(LEAST, fraction)))


def raked(n: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], fraction: float, rounds: int) -> np.ndarray:
    """Cells' expected tokens, n at most, after raking to goals (shares by value); codes number the value of each dimension in each cell."""
    total = n.sum()
    most = min((float((np.bincount(c, n, len(g))[g > 0] / g[g > 0]).min()) / total for c, g in zip(codes, goals) if total and (g > 0).any()), default=1.0)
    fraction = reachable(most, fraction)
    w = fraction * n
    for _ in range(rounds):
        for c, goal in zip(codes, goals):
            now = np.bincount(c, w, len(goal))
            w = np.minimum(n, w * np.divide(goal * (fraction * total), now, out=np.zeros_like(now), where=now > 0)[c])
    return np.where(n > 0, w, 0.0)


KEYS = [f"__{d}" for d in DIMENSIONS]
CELL = ", ".join(f"{k} string" for k in KEYS) + ", tokens long, docs long, w double, p double"


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("docs"))


def goals_of(cells: DataFrame, dimension: str, targets: Targets, evenness: float) -> DataFrame:
    """Value, goal (share of tokens), own (tokens) and n (cells) of a dimension."""
    key = f"__{dimension}"
    own = cells.groupBy(key).agg(F.sum("tokens").alias("own"), F.count("*").alias("n"))
    given = targets.get(dimension, {})
    share = F.element_at(F.create_map(*(F.lit(x) for pair in given.items() for x in pair)), F.col(key)) if given else F.lit(None).cast("double")
    own = cut(own.withColumn("given", share.cast("double")).withColumn("even", F.when((F.col("own") > 0) & F.col("given").isNull(), F.pow("own", F.lit(evenness))).otherwise(0.0)))
    even = own.agg(F.sum("even")).first()[0] or 0.0
    left = max(0.0, 1.0 - sum(r["given"] for r in own.filter("given IS NOT NULL").select("given").collect()))  # at most a row for each target
    made = own.withColumn("goal", F.when(F.col("own") > 0, F.coalesce("given", F.lit(0.0)) + (F.col("even") / even * left if even else 0.0)).otherwise(0.0))
    norm = made.agg(F.sum("goal")).first()[0] or 1.0
    return made.select(key, (F.col("goal") / norm).alias("goal"), "own", "n")


def rake_cells(cells: DataFrame, targets: Targets | None = None, evenness: float = EVENNESS, fraction: float = FRACTION, most: int = MOST_CELLS, rounds: int = ROUNDS) -> tuple[DataFrame, bool]:
    """Cells with expected tokens w and probability p, and whether they are few: on the driver within `most` cells, else in Spark by the same steps."""
    targets = checked(targets)
    few = cells.select(*KEYS, "tokens", "docs").limit(most + 1).toPandas()
    if len(few) <= most:
        n = few["tokens"].to_numpy(float)
        codes, goals = [], []
        for d, k in zip(DIMENSIONS, KEYS):
            kind = few[k].astype("category").cat
            given = np.array([targets.get(d, {}).get(v, np.nan) for v in kind.categories], float)
            codes.append(kind.codes.to_numpy())
            goals.append(goal_shares(np.bincount(codes[-1], n, len(given)), given, evenness))
        w = raked(n, codes, goals, fraction, rounds) if len(few) else n
        few["w"], few["p"] = w, np.where(n > 0, np.divide(w, n, out=np.zeros_like(w), where=n > 0), fraction)
        return cells.sparkSession.createDataFrame(few.astype({"tokens": "int64", "docs": "int64", "w": "float64", "p": "float64"}), CELL), True
    out = cut(cells)
    total = out.agg(F.sum("tokens")).first()[0] or 0
    reach = 1.0
    for d, key in zip(DIMENSIONS, KEYS):
        goals = cut(goals_of(out, d, targets, evenness))
        least = goals.filter("goal > 0").agg(F.min(F.col("own") / F.col("goal"))).first()[0]
        reach = min(reach, least / total) if least is not None and total else reach
        out = dealt_join(out, goals.select(key, F.col("goal").alias(f"goal{key}"), "n"), [key])
    wanted = reachable(reach, fraction)
    out = cut(out.withColumn("w", F.col("tokens") * F.lit(float(wanted))))
    for _ in range(rounds):
        for key in KEYS:
            now = out.groupBy(key).agg(F.sum("w").alias("now"), F.count("*").alias("n"))
            step = F.col("w") * F.col(f"goal{key}") * F.lit(float(wanted * total)) / F.col("now")
            out = dealt_join(out, now, [key]).withColumn("w", F.when(F.col("now") > 0, F.least(F.col("tokens").cast("double"), step)).otherwise(0.0)).drop("now")
            out = cut(out)
    p = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(fraction)
    return cut(out.select(*KEYS, "tokens", "docs", "w", p.alias("p"))), False


def with_cells(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    """rows (with KEYS) with tokens, w and p of their cell; a cell with many of the rows is dealt out."""
    if few:
        return rows.join(F.broadcast(cells.drop("docs")), KEYS)
    return dealt_join(rows, cells.withColumnRenamed("docs", "n"), KEYS)


def marginals(docs: DataFrame, targets: Targets | None = None, fraction: float = FRACTION) -> DataFrame:
    """dimension, value, and shares of tokens: own, target, sampled (expected), and whether the target is met within NEAR; one that isn't is out of reach."""
    made = described(docs)
    cells = cut(cells_of(docs.select(*(c.alias(name) for name, c in made.items()))))
    out = None
    done, _ = rake_cells(cells, targets, fraction=fraction)
    total, kept = done.agg(F.sum("tokens"), F.sum("w")).first()
    for d, key in zip(DIMENSIONS, KEYS):
        share = lambda c, of: (F.sum(c) / F.lit(float(of or 0) or 1.0))
        one = done.groupBy(key).agg(share("tokens", total).alias("own"), share("w", kept).alias("sampled"))
        one = one.join(goals_of(cells, d, checked(targets), EVENNESS).select(key, "goal"), key).select(F.lit(d).alias("dimension"), F.col(key).alias("value"), "own", F.col("goal").alias("target"), "sampled")
        out = out.unionByName(one) if out is not None else one
    return out.withColumn("met", F.abs(F.col("sampled") - F.col("target")) <= NEAR)


def mixture(docs: DataFrame, fraction: float = FRACTION, targets: Targets | None = None, most: int = MOST_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (expected over own tokens of the cell, 1 on average over the corpus), probability, sampled of each row."""
    made = described(docs)
    rows = cut(docs.select("doc_id", *(c.alias(name) for name, c in made.items())))
    cells, few = rake_cells(cells_of(rows), targets, fraction=fraction, most=most)
    tokens, expected = cells.agg(F.sum("tokens"), F.sum("w")).first()
    scale = float(tokens or 0) / expected if expected else 0.0
    joined = with_cells(rows, cells, few)
    return joined.select(
        "doc_id",
        *(F.col(f"__{d}").alias(d) for d in DIMENSIONS),
        F.col("__tokens").alias("n_tokens"),
        F.round(F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens") * F.lit(scale)).otherwise(0.0), 6).alias("weight"),
        F.round("p", 6).alias("probability"),
        (F.col("__draw") < F.col("p")).alias("sampled"),
    )


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, targets: Targets | None = None, most: int = MOST_CELLS) -> DataFrame:
    """The rows of docs that the mixture samples, with the columns of docs; texts are read twice rather than stored or shuffled, while cells are few."""
    rows = docs.select(F.struct("*").alias("__row"), *(c.alias(name) for name, c in described(docs).items()))
    joined = with_cells(rows, *rake_cells(cells_of(rows), targets, most=most))
    return joined.filter(F.col("__draw") < F.col("p")).select("__row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same steps as common table expressions."""
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS.items())
    steps, last = [], "goals"
    for k in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"w{k}{d} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN least(n, w * g_{d} * f * total / sum(w) OVER (PARTITION BY {d})) ELSE 0 END AS w) FROM {last})")
            last = f"w{k}{d}"
    goals = ", ".join(f"CASE WHEN m_{d} > 0 THEN pow(m_{d}, {EVENNESS}) / (SELECT sum(pow(x, {EVENNESS})) FROM (SELECT sum(n) AS x FROM cells GROUP BY {d}) WHERE x > 0) ELSE 0 END AS g_{d}" for d in DIMENSIONS)
    reach = ", ".join(f"min(CASE WHEN g_{d} > 0 THEN m_{d} / g_{d} / total END)" for d in DIMENSIONS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw FROM documents),
rows_ AS MATERIALIZED (SELECT doc_id, source, lang, CASE {cases} ELSE '{OTHER}' END AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n, draw FROM docs),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS n FROM rows_ GROUP BY ALL),
sums AS (SELECT *, {", ".join(f"sum(n) OVER (PARTITION BY {d}) AS m_{d}" for d in DIMENSIONS)} FROM cells),
shares AS MATERIALIZED (SELECT source, lang, topic, n, {", ".join(f"m_{d}" for d in DIMENSIONS)}, sum(n) OVER () AS total, {goals} FROM sums),
fraction AS MATERIALIZED (SELECT least({FRACTION}, greatest({ROOM} * coalesce(least({reach}), 1), least({LEAST}, {FRACTION})))::DOUBLE AS f FROM shares),
goals AS MATERIALIZED (SELECT *, n * f AS w FROM shares, fraction),
{", ".join(steps)},
found AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN n > 0 THEN w / n * (SELECT sum(n) / sum(w) FROM {last}) ELSE 0 END AS r, CASE WHEN n > 0 THEN w / n ELSE {FRACTION} END AS p FROM {last})
SELECT doc_id, source, lang, topic, CAST(n AS BIGINT) AS n_tokens, round(r, 6) AS weight, round(p, 6) AS probability, draw < p AS sampled
FROM rows_ JOIN found USING (source, lang, topic)"""


QUERIES = {"op10_mixing": op10_mixing}
SQL = {"op10_mixing": oracle()}

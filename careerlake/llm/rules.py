"""Quality rules under weak supervision.

Rules vote for a text, against it or abstain. Expectation-maximisation over the counts of vote patterns of the whole corpus estimates the
share of good texts and, of each rule, how often it votes against good and against bad texts; the posterior of each pattern gives the
verdict, so that rules which agree with the others weigh more than one that stands alone. Texts that fail the base rules have lost
already and don't take part in the estimate: most of them repeat themselves, and three rules see that, so they would make up the bad
class by themselves. The patterns are at most 3 ** len(RULES), whatever the corpus, so their counts may go to the driver.

A null text counts as empty and has no words, so that base_failed holds. Equal texts get equal verdicts; repeated rows stay. A
posterior of exactly 0.5 keeps a text. Very long texts are read whole, in time and memory in proportion to their length; no rule's
measure falls or rises with length. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import by_text, cut, table

WINDOW, BLOCK = 8, 50
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; hundredths of the words
STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_capitals", "n_letters", "n_marks", "n_local", "n_ascii",
)
SCHEMA = pa.schema([(name, pa.int64()) for name in STATS])
DDL = ", ".join(f"{name} long" for name in STATS)

SYMBOLS, CAPITALS, MARKS, VISIBLE = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", bytes(range(0x21, 0x7F))
LETTERS = CAPITALS + CAPITALS.lower()


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Of each text, the words in windows of WINDOW words that it has twice or more.

    Windows of 2, 4 and 8 words get exact numbers from pairs of numbers of their halves.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    number = dict(zip(dict.fromkeys(chain.from_iterable(words)), count()))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, total)
    text = np.repeat(np.arange(len(words)), sizes)
    n = 1
    while n < WINDOW:
        ids = pd.factorize(ids[:-n] * (int(ids.max()) + 1) + ids[n:])[0]
        n *= 2
    inside = text[: len(ids)] == text[WINDOW - 1 :]
    key = pd.factorize(ids * len(words) + text[: len(ids)])[0]
    twice = (np.bincount(key[inside], minlength=len(ids))[key] >= 2) & inside
    edge = np.zeros(total + 1, np.int64)
    edge[: len(ids)] += twice
    edge[WINDOW : WINDOW + len(ids)] -= twice
    return np.bincount(text, weights=np.cumsum(edge[:-1]) > 0, minlength=len(words)).astype(np.int64)


def text_stats(texts: list[str]) -> list[tuple[int, ...]]:
    """The numbers STATS of each text. n_local adds up the different words of each BLOCK words, n_ascii counts the visible ASCII characters."""
    rows, all_words = [], []
    for t in texts:
        data = t.encode()
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        less = lambda drop, data=data: len(data) - len(data.translate(None, drop))
        blanks = less(b" \t\n\x0b\x0c\r")
        local = sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK))
        rows.append((len(words), len(t) - blanks, less(SYMBOLS), len(lines) - len(set(lines)), len(lines), len(set(words)), less(CAPITALS), less(LETTERS), less(MARKS), local, less(VISIBLE)))
        all_words.append(words)
    return [(*r[:4], again, *r[4:]) for r, again in zip(rows, repeated_words(all_words).tolist())]


def stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return by_text(docs, SCHEMA, DDL, text_stats, keep)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """Of each rule, when it votes for a text and when against; it abstains else."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda name, of=n: F.col(name) / of
    length, repeats, symbols = share("word_chars"), share("n_repeat_words"), share("n_symbols")
    twins, variety = share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), share("n_local")
    loud, marks = share("n_capitals", F.greatest(F.col("n_letters"), F.lit(1))), share("n_marks")
    letters, latin = share("n_letters", F.greatest(F.col("n_ascii"), F.lit(1))), 2 * F.col("n_ascii") > F.col("word_chars")
    return {
        "enough_words": (n >= 50, n < LEAST_WORDS),
        "word_length": (length.between(4, 6.5), (length < 3.5) | (length > 7.2)),
        "few_symbols": (symbols < 0.02, symbols > 0.1),
        "few_repeats": (repeats < 0.05, repeats > 0.15),
        "own_lines": ((twins < 0.05) & (F.col("n_lines") > 2), (twins > 0.3) & (F.col("n_lines") > 3)),
        "varied_words": ((n >= 30) & (variety > 0.8), (n >= 30) & (variety < 0.6)),
        "calm_case": (loud < 0.06, (loud > 0.3) & (n >= 5)),
        "few_marks": (marks < 0.05, marks > 0.2),
        "mostly_letters": (latin & (letters > 0.93), latin & (letters < 0.9)),
    }


#: Rules in order; the votes of a text are digits in base 3: 0 abstains, 1 against, 2 for.
RULES = ("enough_words", "word_length", "few_symbols", "few_repeats", "own_lines", "varied_words", "calm_case", "few_marks", "mostly_letters")


def pattern() -> Column:
    made, out = rules(), F.lit(0)
    for k, name in enumerate(RULES):
        good, bad = made[name]
        out = out + F.when(good, 2 * 3**k).when(bad, 3**k).otherwise(0)
    return out.cast("int")


class Belief(NamedTuple):
    """Beta priors (votes against and for, as counts seen before): of rules on good texts, of rules on bad texts, and of good and bad texts."""

    good: tuple[float, float] = (1, 19)
    bad: tuple[float, float] = (2, 2)
    share: tuple[float, float] = (9, 1)


class Model(NamedTuple):
    """Share of good texts, and of the votes of each rule on good and on bad texts the share against."""

    share: float
    good: np.ndarray
    bad: np.ndarray


def votes_of(codes: np.ndarray, n_rules: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes against and for, a row for each pattern."""
    votes = codes[:, None] // 3 ** np.arange(n_rules) % 3
    return (votes == 1).astype(float), (votes == 2).astype(float)


def believed(model: Model, codes: np.ndarray) -> np.ndarray:
    """Posterior probability of good by vote pattern; only votes count, not abstentions."""
    against, favour = votes_of(codes, len(model.good))
    logit = np.log(model.share / (1 - model.share)) + against @ np.log(model.good / model.bad) + favour @ np.log((1 - model.good) / (1 - model.bad))
    return 1 / (1 + np.exp(-logit.clip(-500, 500)))


def estimate(counts: dict[int, float], n_rules: int = len(RULES), belief: Belief = Belief(), rounds: int = 500, close: float = 1e-10) -> Model:
    """The likeliest model of the counts of vote patterns, by expectation-maximisation from the means of the priors, which say which class is the good one."""
    model = Model(belief.share[0] / sum(belief.share), np.full(n_rules, belief.good[0] / sum(belief.good)), np.full(n_rules, belief.bad[0] / sum(belief.bad)))
    if not counts:
        return model
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes.tolist()], float)
    against, favour = votes_of(codes, n_rules)
    before = None
    for _ in range(rounds):
        posterior = believed(model, codes)
        if before is not None and np.abs(posterior - before).max() < close:
            break
        before, good, bad = posterior, weight * posterior, weight * (1 - posterior)
        share = lambda w, prior: (w @ against + prior[0]) / (w @ (against + favour) + sum(prior))
        model = Model(float((good.sum() + belief.share[0]) / (weight.sum() + sum(belief.share))), share(good, belief.good), share(bad, belief.bad))
    return model


def posteriors(numbers: DataFrame) -> dict[int, float]:
    """By the vote patterns of all rows of stats()."""
    seen = numbers.groupBy(pattern().alias("votes")).agg(F.count("*").alias("n"), F.count_if(~base_failed()).alias("n_left")).collect()
    model, codes = estimate({r["votes"]: r["n_left"] for r in seen if r["n_left"]}), np.array([r["votes"] for r in seen], int)
    return dict(zip(codes.tolist(), believed(model, codes).tolist()))


def with_posterior(numbers: DataFrame, found: dict[int, float]) -> DataFrame:
    """numbers with `posterior`; found has at most 3 ** len(RULES) entries."""
    rows = numbers.sparkSession.createDataFrame(list(found.items()), "votes int, posterior double")
    return numbers.withColumn("votes", pattern()).join(F.broadcast(rows), "votes", "left")


def judge(numbers: DataFrame, found: dict[int, float]) -> DataFrame:
    kept = ~base_failed() & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= 0.5)
    return with_posterior(numbers, found).withColumns({"base_failed": base_failed(), "kept": kept})


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row."""
    numbers = cut(stats(docs))
    out = judge(numbers, posteriors(numbers))
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "posterior")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; statistics are computed twice rather than shuffled with texts."""
    found = posteriors(stats(docs, ()))
    row = docs.select(F.struct("*").alias("__row"), "text")
    return judge(stats(row, ("__row",)), found).filter("kept").select("__row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL: dict[str, str] = {}

"""Near matches of word runs with names: the longest common subsequence in bit vectors, behind an index of name segments.

Two strings of n and m letters score 200 * lcs / (n + m), so at a threshold they are d = (1 - threshold / 100) * (n + m) insertions and
deletions apart at most. Cut a name into d + 1 segments: one of them is untouched by d edits, and stands in the run at most d letters
off its place. Only runs that hold such a segment are compared. In an array of runs the index is a map by length, so nothing is joined; for names by the
thousand it is a table, joined by segment, length and place. In whole texts runs aren't made at all until sums over their words say that
they may be near; see near_in().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.conf import DEFAULT, Conf
from careerlake.functions.text import sql_string
from careerlake.sources.tables import ship

#: Letters of a name that a bit vector of 64 bits takes; longer names are compared a row of the table at a time.
BITS = 62


def checked(conf: Conf) -> int:
    """The threshold; below 75 a name can have more edits than letters, and no segment tells."""
    if not 75 <= conf.fuzzy_at <= 100:
        raise ValueError("fuzzy_at: 75 to 100")
    return conf.fuzzy_at


def lengths(n: int, at: int) -> range:
    """Lengths that a run near a name of n letters can have."""
    return range(math.ceil(n * at / (200 - at)), math.floor(n * (200 - at) / at) + 1)


def edits(n: int, m: int, at: int) -> int:
    """Insertions and deletions that lengths n and m allow at a threshold."""
    return (n + m) * (100 - at) // 100


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each of `parts` parts of n letters, of nearly equal lengths."""
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def masks(name: str) -> dict[str, int]:
    """The places of each letter as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(name):
        out[c] = out.get(c, 0) | 1 << i
    return out


def table_of(names: list[str]) -> Column:
    """An array of name structs: letters, all (their bits), and the bits of each letter."""
    rows = []
    for name in names:
        places = ", ".join(f"{sql_string(c)}, {bits}L" for c, bits in masks(name).items())
        rows.append(f"named_struct('n', {len(name)}, 'all', {(1 << len(name)) - 1}L, 'places', map({places}))")
    return F.expr(f"array({', '.join(rows)})")


def by_length(names: list[str], at: int) -> Column:
    """The index: for each length of a run the names that it may be near, with number, key, segments, and the edits that are allowed."""
    some: dict[int, list[str]] = {}
    for k, name in enumerate(names):
        for m in lengths(len(name), at):
            d = edits(len(name), m, at)
            parts = ", ".join(sql_string(name[a : a + n]) for a, n in segments(len(name), d + 1))
            some.setdefault(m, []).append(f"named_struct('i', {k}, 'key', {sql_string(name)}, 'parts', array({parts}), 'd', {d})")
    return F.expr("map(" + ", ".join(f"{m}, array({', '.join(rows)})" for m, rows in sorted(some.items())) + ")")


def common(letters: Column, name: Column) -> Column:
    """Length of the longest common subsequence of letters and a name of table_of(), a step a letter."""

    def step(v: Column, c: Column) -> Column:
        hit = v.bitwiseAND(F.coalesce(F.try_element_at(name["places"], c), F.lit(0).cast("long")))
        return (v + hit).bitwiseOR(v - hit).bitwiseAND(name["all"])

    return name["n"] - F.bit_count(F.aggregate(letters, name["all"], step))


def in_order(words: Column) -> Column:
    """The words sorted, with single blanks between."""
    return F.array_join(F.sort_array(F.split(words, " ")), " ")


def sorted_name(name: str) -> str:
    return " ".join(sorted(name.lower().split()))


def near_names(runs: Column, names: list[str], conf: Conf = DEFAULT) -> Column:
    """Of each name that a run is near, in any order of the words: i (its number), word (the nearest run, of equally near ones the smallest), score.

    runs: distinct word runs of a text in lower case. names: at most BITS letters each.
    """
    if any(not 0 < len(n) <= BITS for n in names):
        raise ValueError(f"names of 1 to {BITS} letters")
    keys = [sorted_name(n) for n in names]
    at = checked(conf)
    index = by_length(keys, at)
    keyed = F.transform(runs, lambda r: F.struct(r.alias("word"), in_order(r).alias("key")))

    def of(r: Column, table: Column) -> Column:
        # with substitutions there are no more edits than without
        close = F.filter(F.try_element_at(index, F.length(r["key"])), lambda t: F.exists(t["parts"], lambda part: F.contains(r["key"], part)) & (F.levenshtein(r["key"], t["key"]) <= t["d"]))
        size = lambda t: F.get(table, t["i"])["n"] + F.length(r["key"])
        scored = F.transform(close, lambda t: F.struct(t["i"].alias("i"), (200.0 * common(F.split(r["key"], ""), F.get(table, t["i"])) / size(t)).alias("score"), r["word"].alias("word")))
        return F.filter(scored, lambda s: s["score"] >= at)

    def best(hits: Column) -> Column:
        numbers = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["i"])))
        return F.transform(
            numbers, lambda i: F.array_min(F.transform(F.filter(hits, lambda h: h["i"] == i), lambda h: F.struct(h["i"].alias("i"), (-h["score"]).alias("lost"), h["word"].alias("word"))))
        )

    hits = F.transform(F.array(table_of(keys)), lambda table: F.flatten(F.filter(F.transform(keyed, lambda r: of(r, table)), lambda h: F.size(h) > 0)))
    found = F.transform(F.transform(hits, best)[0], lambda b: F.struct(b["i"].alias("i"), b["word"].alias("word"), (-b["lost"]).alias("score")))
    return found


#: Different words whose subsequences a task remembers at a time, and words of a text that are looked at together.
WORDS, AT_ONCE = 100_000, 20_000
FOUND = pa.list_(pa.struct([("i", pa.int32()), ("word", pa.string()), ("score", pa.float64())]))


class Margins:
    """How near each word of a text may bring a run to each name: 200 * lcs - at * letters, which add up over the words of a run to a bound.

    The common subsequence of a run and a name is at most the sum of those of its words, and a blank between two words. All names lie in
    one bit vector, each with a bit above it that takes its carry.
    """

    def __init__(self, names: list[str], at: int, most: int, but_equal: bool):
        keys = [sorted_name(n) for n in names]
        self.at, self.most, self.n = at, most, [len(k) for k in keys]
        self.own = [n.lower() if but_equal else None for n in names]
        starts = np.cumsum([0, *(n + 1 for n in self.n)])
        self.all, self.bits = 0, int(starts[-1])
        self.places: dict[str, int] = {}
        for key, start in zip(keys, starts.tolist()):
            self.all |= ((1 << len(key)) - 1) << start
            for c, bits in masks(key).items():
                self.places[c] = self.places.get(c, 0) | bits << start
        self.starts, self.longest = starts[:-1], max(lengths(max(self.n), at))
        n, blanks = np.array(self.n), np.array([k.count(" ") for k in keys])
        self.least = [(at * (n + k) - 200 * np.minimum(k, blanks)).astype(np.int32) for k in range(most)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.margins = np.zeros((0, len(self.n)), np.int32)

    def common(self, words: list[str]) -> np.ndarray:
        """Lengths of the longest common subsequences of words and names."""
        left = []
        for w in words:
            v = self.all
            for c in w:
                hit = v & self.places.get(c, 0)
                v = ((v + hit) | (v - hit)) & self.all
            left.append(v.to_bytes(self.bits // 8 + 1, "little"))
        bits = np.unpackbits(np.frombuffer(b"".join(left), np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
        return np.array(self.n) - np.add.reduceat(bits[:, : self.bits], self.starts, axis=1, dtype=np.int32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Margins of the words, a row each; those of words longer than any near run are out of reach."""
        if len(self.known) > WORDS:
            self.forget()
        new = list({w for w in words if w not in self.known})
        if new:
            spelt = [w.decode() for w in new]
            fit = [len(w) <= self.longest for w in spelt]
            made = np.full((len(new), len(self.n)), -1_000_000, np.int32)
            if any(fit):
                short = [w for w, ok in zip(spelt, fit) if ok]
                made[np.array(fit)] = 200 * self.common(short) - self.at * np.array([len(w) for w in short])[:, None]
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            # doubled when full, so that rows aren't copied at each text
            if first + len(new) > len(self.margins):
                self.margins = np.concatenate([self.margins[:first], made, np.zeros_like(self.margins)])
            else:
                self.margins[first : first + len(new)] = made
        return self.margins[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def near(self, text: bytes) -> list[dict]:
        """Of each name that a run of words is near the nearest run, then the smallest."""
        words, runs = text.split(), set()
        for start in range(0, len(words), AT_ONCE):
            some = words[start : start + AT_ONCE + self.most - 1]
            margin = self.of(some)
            added = margin
            for k in range(min(self.most, len(some))):
                added = margin if k == 0 else added[:-1] + margin[k:]
                runs |= {tuple(some[i : i + k + 1]) for i in np.flatnonzero((added >= self.least[k]).any(axis=1))}
        best: dict[int, tuple[float, str]] = {}
        if runs:
            spelt = [(b" ".join(r).decode(), b" ".join(sorted(r)).decode()) for r in runs]
            for (run, key), row in zip(spelt, self.common([key for _, key in spelt]).tolist()):
                for i, lcs in enumerate(row):
                    score = 200.0 * lcs / (self.n[i] + len(key))
                    if score >= self.at and run != self.own[i]:
                        best[i] = min(best.get(i, (0.0, "")), (-score, run))
        return [{"i": i, "word": word, "score": -lost} for i, (lost, word) in sorted(best.items())]


def near_in(text: Column, names: list[str], conf: Conf = DEFAULT, most: int = 3, but_equal: bool = False) -> Column:
    """near_names() of the runs of one to `most` words of a text in any case; but_equal: a run that is the name itself doesn't count.

    A text is read once, in batches of rows; only runs whose words' margins allow it are put together and compared.
    """
    at = checked(conf)
    if not names or any(not n.split() for n in names):
        raise ValueError("names of a letter or more")
    ship(SparkSession.active())

    @F.arrow_udf("array<struct<i: int, word: string, score: double>>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        margins = Margins(names, at, most, but_equal)
        for some in texts:
            yield pa.array([margins.near(t.as_py()) for t in some], FOUND)

    return found(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))


def join_names(runs: DataFrame, names: DataFrame, conf: Conf = DEFAULT) -> DataFrame:
    """word, name, score of distinct runs (column word) near a name (column name), for names by the thousand: the index is joined by segment, length and place.

    Both sides are rows of equal keys, so no pair is made that doesn't share a segment at its place. Lengths are at most those that the
    threshold allows, whatever the words; each pair is compared once.
    """
    at = checked(conf)
    keys = names.select("name", in_order(F.lower("name")).alias("key")).filter("key != ''").withColumn("n", F.length("key"))
    m = F.explode(F.sequence(F.ceil(F.col("n") * at / (200 - at)), F.floor(F.col("n") * (200 - at) / at))).alias("m")
    keys = keys.select("*", m).withColumn("d", F.floor((F.col("n") + F.col("m")) * (100 - at) / 100))
    keys = keys.select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k"))
    start, end = F.floor(F.col("n") * F.col("k") / (F.col("d") + 1)), F.floor(F.col("n") * (F.col("k") + 1) / (F.col("d") + 1))
    keys = keys.withColumns({"start": start, "size": end - start}).filter("size > 0")
    index = keys.select("name", "key", "n", "m", "start", "size", "d", F.expr("substring(key, int(start) + 1, int(size))").alias("segment"))
    # which pieces of a run are looked up: the sizes and places that names of the index have for its length
    asked = index.select("m", "size", F.explode(F.sequence(F.greatest(F.col("start") - F.col("d"), F.lit(0)), F.least(F.col("start") + F.col("d"), F.col("m") - F.col("size")))).alias("place")).filter("place >= 0").distinct()
    keyed = runs.select("word", in_order(F.col("word")).alias("run")).withColumn("m", F.length("run").cast("long"))
    pieces = keyed.join(F.broadcast(asked.groupBy("m").agg(F.collect_list(F.struct("size", "place")).alias("places"))), "m")  # sizes and places of lengths: as many as letters squared
    pieces = pieces.select("word", "run", "m", F.explode("places").alias("p")).select("word", "run", "m", "p.place", F.expr("substring(run, int(p.place) + 1, int(p.size))").alias("segment"))
    pairs = pieces.join(index, ["m", "segment"]).filter(F.abs(F.col("place") - F.col("start")) <= F.col("d")).select("word", "run", "name", "key").distinct()
    return pairs.withColumn("score", similarity(F.col("run"), F.col("key"))).filter(F.col("score") >= at).select("word", "name", "score")


def similarity(a: Column, b: Column) -> Column:
    """200 * lcs / letters of both, with the letters' places in b as bits, or a row of the table at a time beyond BITS letters."""

    def places(letters: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        of = lambda c: F.aggregate(F.transform(letters, lambda x, i: F.when(x == c, bit(i)).otherwise(0)), F.lit(0).cast("long"), lambda v, x: v + x)
        return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, of(c))))

    spelt = F.transform(F.array(F.split(b, "")), lambda letters: F.struct(F.length(b).alias("n"), (F.pow(F.lit(2.0), F.length(b)).cast("long") - 1).alias("all"), places(letters).alias("places")))
    short = F.transform(spelt, lambda t: common(F.split(a, ""), t))[0]
    return 200.0 * F.when(F.length(b) <= BITS, short).otherwise(table_lcs(a, b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def table_lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, a row of the table at a time."""

    def row(before: Column, c: Column) -> Column:
        def cell(acc: Column, x: Column) -> Column:
            up, corner = F.get(before, F.size(acc)), F.get(before, F.size(acc) - 1)
            return F.array_append(acc, F.greatest(F.element_at(acc, -1), up, F.when(x == c, corner + 1).otherwise(0)))

        return F.aggregate(F.split(b, ""), F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), (F.length(b) + 1).cast("int"))
    return F.element_at(F.aggregate(F.split(a, ""), start, row), -1)

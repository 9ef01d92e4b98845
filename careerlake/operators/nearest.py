"""The nearest word of a dictionary within one or two edits, for batches of words: a symmetric-delete index in arrays.

An edit loses, adds or changes a letter, or swaps two neighbours. What is left of two words within k edits, when up to k letters are left out
of each, has a word in common. These are not made: sums of letters times powers of a number are their digests, and a digest without two letters
is three differences of such sums. Words of over SHORT letters, of which too much could be left, are cut into 2 k + 1 parts: k edits touch
2 k of them at most, so one stands in the other word as it is, k letters off its place at most. Words that share a digest are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from careerlake.sources.tables import ship

SHORT = 30
#: Digests, and cells of compared words, that are held at a time.
AT_ONCE = 1 << 21
#: An odd number and what undoes a multiplication by it, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
FOUND = "word string, suggestion string, n long"


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [base] * n, np.uint64))


def summed(rows: np.ndarray) -> np.ndarray:
    """For each row of letters the sums of its first 0, 1, ... letters times powers of BASE."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + 1) * powers(BASE, rows.shape[1])[:-1], axis=1, out=out[:, 1:])
    return out


def left_of(rows: np.ndarray, edits: int) -> np.ndarray:
    """Digests of what is left of each word of n letters without up to `edits` of these."""
    n, sums = rows.shape[1], summed(rows)
    one, two = (np.uint64(pow(UNDO, k, 1 << 64)) for k in (1, 2))
    total = sums[:, -1:]
    out = [total, sums[:, :-1] + (total - sums[:, 1:]) * one]
    if edits == 2:
        i, j = np.triu_indices(n, 1)
        out.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * one + (total - sums[:, j + 1]) * two)
    return np.concatenate(out, axis=1)


def parts_of(rows: np.ndarray, edits: int, asked: bool) -> np.ndarray:
    """Digests of the parts of each long word; asked: of what may be a part of a word within `edits`."""
    n, sums = rows.shape[1], summed(rows)
    undo, parts, slack, out = powers(UNDO, n), 2 * edits + 1, edits if asked else 0, []
    for m in range(n - slack, n + slack + 1):
        for k in range(parts):
            start, size = m * k // parts, m * (k + 1) // parts - m * k // parts
            for s in range(max(start - slack, 0), min(start + slack, n - size) + 1):
                out.append((sums[:, s + size] - sums[:, s]) * undo[s] + np.uint64((m * parts + k) * BASE % (1 << 64)))
    return np.stack(out, axis=1)


def compared(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Which columns of a are within `edits` of those of b; a row for each letter."""
    n, m, far = len(a), len(b), np.uint8(edits + 1)
    same = np.full(a.shape[1], 0, np.uint8)
    # of the table of distances only what lies next to the diagonal can count
    table: list[dict[int, np.ndarray]] = []
    for i in range(n + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - edits), min(m, i + edits) + 1):
            if i == 0 or j == 0:
                row[j] = same + np.uint8(i + j)
                continue
            cell = np.minimum(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), far)
            for beside in (table[i - 1].get(j), row.get(j - 1)):
                if beside is not None:
                    np.minimum(cell, beside + np.uint8(1), out=cell)
            # a swap, and with two edits also one with a letter lost or added in between
            for p, q in ((0, 0), (1, 0), (0, 1))[: 1 if edits == 1 else 3]:
                x, y = i - 2 - p, j - 2 - q
                if x >= 0 and y >= 0 and y in table[x]:
                    crossed = (a[x] == b[j - 1]) & (a[i - 1] == b[y])
                    np.minimum(cell, np.where(crossed, table[x][y] + np.uint8(1 + p + q), far), out=cell)
            row[j] = cell
        table.append(row)
        if i >= 3:
            table[i - 3] = {}
    return table[n][m] <= edits if m in table[n] else same > 0


class Words:
    """Words as one array of letters."""

    def __init__(self, words: list[str]) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = letters.astype(np.uint8) if len(letters) == 0 or letters.max() < 256 else letters
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def rows(self, which: np.ndarray, size: int) -> np.ndarray:
        return self.letters[self.starts[which][:, None] + np.arange(size)]

    def groups(self, edits: int) -> Iterator[tuple[int, np.ndarray]]:
        """Words of one length, as many as may be looked at together."""
        for size in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == size)
            step = max(1, AT_ONCE // (1 + size + (size * size // 2 if size <= SHORT + edits else 6 * (2 * edits + 1) ** 2)))
            for at in range(0, len(which), step):
                yield size, which[at : at + step]


class Nearest:
    """Of each word asked for the place of the first one in `words` within `edits` of it."""

    def __init__(self, words: list[str], edits: int) -> None:
        self.edits, self.words = edits, Words(words)
        # a digest's upper bits, then the word's place: sorted, they are the index
        self.place = np.uint64((1 << len(words).bit_length()) - 1)
        some = [np.zeros(0, np.uint64)]
        for size, which in self.words.groups(edits):
            rows = self.words.rows(which, size)
            made = [left_of(rows, edits)] if size <= SHORT + edits else []
            made += [parts_of(rows, edits, False)] if size > SHORT - edits else []
            some += [np.unique((x & ~self.place) | which[:, None].astype(np.uint64)) for x in made]
        self.index = np.concatenate(some)
        self.index.sort()
        # most digests asked for aren't there, which a table of their first bits tells sooner
        self.shift = np.uint64(64 - max(16, (4 * len(self.index)).bit_length()))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)
        self.there[self.index >> self.shift] = True

    def pairs(self, digests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of digests and places of words that share one of them, so many at a time."""
        flat = digests.ravel()
        held = np.flatnonzero(self.there[flat >> self.shift])
        low = flat[held] & ~self.place
        start = np.searchsorted(self.index, low)
        n = np.searchsorted(self.index, low | self.place, "right") - start
        held, start, n = held[n > 0] // digests.shape[1], start[n > 0], n[n > 0]
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + AT_ONCE, "right")))
            some = n[at:to]
            within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            yield np.repeat(held[at:to], some), (self.index[np.repeat(start[at:to], some) + within] & self.place).astype(np.int64)
            at = to

    def of(self, asked: list[str]) -> np.ndarray:
        """Places in `words`, len(words) where none is near."""
        words, none = Words(asked), len(self.words.sizes)
        out = np.full(len(asked), none, np.int64)
        for size, which in words.groups(self.edits):
            rows = words.rows(which, size)
            best = np.full(len(which), none, np.int64)
            for row, place in self.pairs(left_of(rows, self.edits) if size <= SHORT else parts_of(rows, self.edits, True)):
                other = self.words.sizes[place]
                for m in range(max(0, size - self.edits), size + self.edits + 1):
                    # a pair may share many digests, and need not be compared if a better one is known
                    fit = np.flatnonzero((other == m) & (place < best[row]))
                    both = np.unique(row[fit] * (none + 1) + place[fit])
                    step = max(1, AT_ONCE // max(1, m))
                    for at in range(0, len(both), step):
                        r, p = np.divmod(both[at : at + step], none + 1)
                        near = compared(np.ascontiguousarray(rows[r].T), np.ascontiguousarray(self.words.rows(p, m).T), self.edits)
                        np.minimum.at(best, r[near], p[near])
            out[which] = best
        return out


def nearest(asked: DataFrame, dictionary: pa.Table, edits: int) -> DataFrame:
    """word, suggestion, n of the words asked for that are within `edits` of one of dictionary (word, n): of these the most frequent, then the smallest."""
    ship(asked.sparkSession)
    ranked = sorted(zip(dictionary["word"].to_pylist(), dictionary["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    names, counts = pa.array([w for w, _ in ranked], pa.string()), pa.array([n for _, n in ranked], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Nearest(names.to_pylist(), edits)
        for batch in batches:
            words = batch.column("word")
            place = index.of(words.to_pylist())
            held = place < len(names)
            at = pa.array(place[held])
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(held)), names.take(at), counts.take(at)], ["word", "suggestion", "n"])

    return asked.select("word").mapInArrow(run, FOUND)

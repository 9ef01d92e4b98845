"""Numbers of tokens without the tokens: byte pairs merged with a heap and a linked list.

The adjacent pair of lowest rank is popped and merged until none has a rank; the count of a pre-token is its number of bytes less its
number of merges. Counts of words are kept in each Python worker, within bounds.

A null text counts as empty (0 tokens). A very long text is counted whole, in memory in proportion to its length. Of pairs of equal rank
the leftmost merges first, as in the library. Repeated rows and repeated or null ids stay, row for row. An empty table gives an empty
result. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.bpe import PATTERN, Kept, learn, split_up, together
from careerlake.llm.common import by_text, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Words kept with their count in a Python worker, at about 200 bytes; counts are small, so more are kept than of encodings.
KEPT = 600_000
SHIFT = 20
#: Bits of a place in a pre-token; texts are shorter than 2 ** 31 bytes.
PLACE = 32
PLACES = (1 << PLACE) - 1


def letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """rank[left << SHIFT | right] of pairs of symbols, and what they become; symbols are numbers, those of bytes in `of_byte`."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            given = json.load(f)
        vocabulary = given["model"]["vocab"]
        self.of_byte = [vocabulary[c] for c in letters()]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in given["model"]["merges"]]
        self.rank = {vocabulary[a] << SHIFT | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.becomes = [vocabulary[a + b] for a, b in pairs]
        self.special = tuple(t["content"] for t in given["added_tokens"])

    def count(self, piece: str) -> int:
        """Tokens of a pre-token."""
        of_byte, becomes, pop, push, rank = self.of_byte, self.becomes, heapq.heappop, heapq.heappush, self.rank.get
        symbols = [of_byte[b] for b in piece.encode()]
        n = len(symbols)
        # of the pair that starts at a place; the rank stands above the place, so that equal ranks go from left to right
        current = [rank(a << SHIFT | b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [r << PLACE | i for i, r in enumerate(current) if r >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        current.append(-1)
        after, before, merges = [*range(1, n + 1)], [*range(-1, n - 1)], 0
        while heap:
            x = pop(heap)
            i, r = x & PLACES, x >> PLACE
            if current[i] != r:
                continue  # one of the pair has been merged since
            merges += 1
            j = after[i]
            k = after[i] = after[j]
            current[j] = -1
            s = symbols[i] = becomes[r]
            if k < n:
                before[k] = i
                new = current[i] = rank(s << SHIFT | symbols[k], -1)
                if new >= 0:
                    push(heap, new << PLACE | i)
            else:
                current[i] = -1
            h = before[i]
            if h >= 0:
                new = current[h] = rank(symbols[h] << SHIFT | s, -1)
                if new >= 0:
                    push(heap, new << PLACE | h)
        return n - merges


class Counter:
    def __init__(self, name: str):
        self.merges = Merges(name)
        count = self.merges.count
        self.pieces = Kept(count, KEPT)
        self.spaced = Kept(lambda w: sum(map(self.pieces.__getitem__, PATTERN.findall(" " + w))), KEPT)
        self.first = Kept(lambda w: sum(map(self.pieces.__getitem__, PATTERN.findall(w))), KEPT)

    def plain(self, text: str, lines: list[list[str]] | None = None) -> int:
        """Tokens of a text without special ones; lines are those of split_up()."""
        lines = lines if lines is not None else split_up(text)
        if lines is None:
            return sum(map(self.pieces.__getitem__, PATTERN.findall(text)))
        total = (len(lines) - 1) * self.pieces["\n"]
        for at, *more in lines:
            total += self.first[at] + sum(map(self.spaced.__getitem__, more))
        return total

    def __call__(self, text: str) -> int:
        """Tokens of a text; special strings in it are a token each."""
        parts = [text]
        for s in self.merges.special:
            parts = [x for p in parts for x in p.split(s)] if s in text else parts
        return len(parts) - 1 + sum(map(self.plain, parts))

    def all(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for group in together(texts):
            special = [any(s in t for s in self.merges.special) for t in group]
            split = [None if s else split_up(t) for t, s in zip(group, special)]
            learn(split, (self.spaced, self.first, self.pieces), lambda new: list(map(self.merges.count, new)), sum)
            out += [self(t) if s else self.plain(t, lines) for t, s, lines in zip(group, special, split)]
        return out


@lru_cache(maxsize=2)
def counter(name: str = VOCABULARY) -> Counter:
    return Counter(name)


def token_counts(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    source = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), "text")
    schema = pa.schema([("n_tokens", pa.int64())])
    counted = by_text(source, schema, "n_tokens long", lambda texts: [(n,) for n in counter(name).all(texts)], ("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}

"""Byte-level BPE: encoding in overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens by itself, in parallel. Where a pre-token boundary of
one chunk is also one of the chunk before, both splits go on alike from there, since the pattern never looks back; at the first such
boundary in the overlap the chunks are stitched. Where an overlap has none (a pre-token longer than it), the earlier chunk takes the
text of the later one in. The stitched pieces are then encoded in parallel. A text of one chunk has nothing to stitch and is encoded by
the task that cuts it. Texts are read once.

A null text counts as empty (no tokens). A very long text is many chunks; its ids are put together in one row. Of pairs of equal rank the
leftmost merges first, as in the library. Repeated rows and repeated or null ids stay, row for row. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerlake.llm.common import SLICE, ship, table, written

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32768, 2048  # code points
#: Words kept with their encoding in a Python worker, at about 200 bytes each; beyond that the store starts anew.
KEPT = 200_000
#: Characters of texts that are split into words together.
TOGETHER = 1 << 20
PATTERN = regex.compile(public_tokenizers.PATTERN)


def crowded(text: str) -> bool:
    """Whether there is other white space than single blanks and line feeds inside; where not, each of these starts a pre-token, whatever is around."""
    return text.split() != text.replace("\n", " ").split(" ")


def split_up(text: str) -> list[list[str]] | None:
    """The words of each line; None where they aren't pre-tokens by themselves."""
    return None if crowded(text) else [line.split(" ") for line in text.split("\n")]


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of at most TOGETHER characters, or one."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


@lru_cache(maxsize=2)
def ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def tokens(name: str = RANKS) -> list[bytes]:
    """Bytes of each token."""
    return [t for t, _ in sorted(ranks(name).items(), key=lambda x: x[1])]


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Tokens of a pre-token: of its bytes the adjacent pair of lowest rank, the leftmost such, is merged until no pair has a rank."""
    if piece in rank:
        return [rank[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 48:
        return merge_long(parts, rank)
    never = len(rank)
    pairs = [rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < never:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank.get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = rank.get(parts[i - 1] + parts[i], never)
    return [rank[p] for p in parts]


def merge_long(parts: list[bytes], rank: dict[bytes, int]) -> list[int]:
    """The same with a heap, for pre-tokens of any length."""
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j] = a + b, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < n and (r := rank.get(parts[x] + parts[after[x]])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
    return [rank[p] for p, live in zip(parts, alive) if live]


@lru_cache(maxsize=2)
def pair_table(name: str = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs of tokens that merge (left << 32 | right), what they become, and the tokens of the bytes. A token's id is its rank."""
    rank = ranks(name)
    if sorted(rank.values()) != list(range(len(rank))):
        raise ValueError("ids are not ranks")
    pairs = {a << 32 | b: t for token, t in rank.items() for k in range(1, len(token)) if (a := rank.get(token[:k])) is not None and (b := rank.get(token[k:])) is not None}
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int64), np.array([rank[bytes([b])] for b in range(256)], np.int64)


#: Longer pre-tokens are merged one by one.
SHORT = 24
NEVER = 1 << 40


def merge_many(pieces: list[bytes], name: str = RANKS) -> list[bytes]:
    """Ids (little-endian, unsigned, 32 bits) of pre-tokens of 1 to SHORT bytes: each step merges one pair of every pre-token."""
    if not pieces:
        return []
    keys, becomes, of_byte = pair_table(name)
    sizes = np.array([len(p) for p in pieces])
    wide = int(sizes.max())
    place = np.arange(wide)
    ids = np.full((len(pieces), wide), -1, np.int64)
    ids[place < sizes[:, None]] = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    out: list[bytes] = [b""] * len(pieces)
    rows = np.arange(len(pieces))

    def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a << 32 | np.maximum(b, 0))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, becomes[at], NEVER)

    rank = np.concatenate([pair_rank(ids[:, :-1], ids[:, 1:]), np.full((len(pieces), 1), NEVER)], 1)
    while len(rows):
        at = rank.argmin(1)
        low = rank[np.arange(len(rows)), at]
        done = low == NEVER
        if done.any():
            count = (ids[done] >= 0).sum(1).tolist()
            line = ids[done].astype("<u4")
            for r, n, x in zip(rows[done].tolist(), count, line):
                out[r] = x[:n].tobytes()
            go = ~done
            rows, ids, rank, at, low = rows[go], ids[go], rank[go], at[go], low[go]
            if not len(rows):
                break
        every = np.arange(len(rows))
        ids[every, at] = low
        # the right one of the pair goes, and with it its place
        shift = place[None, : ids.shape[1]] + (place[None, : ids.shape[1]] > at[:, None])
        ids = np.take_along_axis(np.concatenate([ids, np.full((len(rows), 1), -1)], 1), shift, 1)
        rank = np.take_along_axis(np.concatenate([rank, np.full((len(rows), 1), NEVER)], 1), shift, 1)
        after = np.where(at + 1 < ids.shape[1], ids[every, np.minimum(at + 1, ids.shape[1] - 1)], -1)
        rank[every, at] = pair_rank(ids[every, at], after)
        inner = np.flatnonzero(at > 0)
        rank[inner, at[inner] - 1] = pair_rank(ids[inner, at[inner] - 1], ids[inner, at[inner]])
    return out


class Kept(dict):
    """What make gives for a word, within `most` words of up to 64 characters."""

    def __init__(self, make: Callable[[str], bytes | int], most: int = KEPT):
        super().__init__()
        self.make, self.most = make, most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()

    def __missing__(self, word: str) -> bytes | int:
        self.room(1)
        out = self.make(word)
        if len(word) <= 64:
            self[word] = out
        return out


@lru_cache(maxsize=2)
def stores(name: str = RANKS) -> tuple[Kept, Kept, Kept]:
    """Ids (little-endian, unsigned, 32 bits) of words with a blank before them, of words at a line's start, and of pre-tokens."""
    rank = ranks(name)

    def piece(p: str) -> bytes:
        return np.array(merge(p.encode(), rank), "<u4").tobytes()

    pieces = Kept(piece)

    def word(w: str) -> bytes:
        found = PATTERN.findall(w)
        return pieces[found[0]] if len(found) == 1 else b"".join(map(pieces.__getitem__, found))

    return Kept(lambda w: word(" " + w)), Kept(word), pieces


def learn(split: list[list[list[str]] | None], kept: tuple[Kept, Kept, Kept], many: Callable[[list[str]], list], add: Callable[[list], bytes | int]) -> None:
    """Brings the words of split texts that the stores lack, all at once: pre-tokens by many, words from theirs by add."""
    spaced, _, pieces = kept
    new: set[str] = set()
    for lines in split:
        for line in lines or ():
            new.update(line[1:])
    new -= spaced.keys()
    # words with odd blanks inside are made one by one
    lacking = [w for w in new if w.isprintable() and len(w) <= 64]
    if not lacking:
        return
    spaced.room(len(lacking))
    found = PATTERN.findall(" " + " ".join(lacking))
    made = set(found) - pieces.keys()
    pieces.room(len(made))
    made = set(found) - pieces.keys()
    pieces.update(zip(made, many(list(made))))
    starts = [k for k, p in enumerate(found) if p[0] == " "]
    for w, a, b in zip(lacking, starts, [*starts[1:], len(found)]):
        spaced[w] = pieces[found[a]] if b == a + 1 else add([pieces[p] for p in found[a:b]])


def encode_all(texts: list[str], name: str = RANKS) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    rank = ranks(name)

    def many(new: list[str]) -> list[bytes]:
        data = [p.encode() for p in new]
        short = [p for p in data if len(p) <= SHORT]
        known = dict(zip(short, merge_many(short, name)))
        return [known[p] if len(p) <= SHORT else np.array(merge(p, rank), "<u4").tobytes() for p in data]

    out: list[bytes] = []
    for group in together(texts):
        split = [split_up(t) for t in group]
        learn(split, stores(name), many, b"".join)
        out += [encode(t, name, lines) for t, lines in zip(group, split)]
    return out


def encode(text: str, name: str = RANKS, lines: list[list[str]] | None = None) -> bytes:
    """Ids of the text as little-endian unsigned 32-bit numbers; lines are those of split_up()."""
    spaced, first, pieces = stores(name)
    lines = lines if lines is not None else split_up(text)
    if lines is None:
        return b"".join(map(pieces.__getitem__, PATTERN.findall(text)))
    out: list[bytes] = []
    for at, *more in lines:
        out += (pieces["\n"], first[at])
        out += map(spaced.__getitem__, more)
    return b"".join(out[1:])


def encode_part(text: str, follow: str, name: str = RANKS) -> bytes:
    """Ids of a text that ends at a pre-token boundary of a longer one, of which follow is the next character.

    It matters where white space ends the text: how a run of it is cut depends on what follows.
    """
    if not follow or not text[-1:].isspace():
        return encode(text, name)
    pieces, out, n = stores(name)[2], [], 0
    for p in PATTERN.findall(text + follow):
        n += len(p)
        if n > len(text):
            break
        out.append(pieces[p])
    return b"".join(out)


def decode(ids: bytes, name: str = RANKS) -> bytes:
    """The bytes of the tokens, one after the other."""
    return b"".join(map(tokens(name).__getitem__, np.frombuffer(ids, "<u4").tolist()))


# ---------------------------------------------------------------- chunks


def boundaries(text: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk as far as the chunk's end can't have changed them, and the text's end if this is the last.

    Where the text goes on, the two pre-tokens at the end are in doubt: the last may be longer, and white space before it be cut otherwise.
    """
    ends = [m.end() for m in PATTERN.finditer(text)]
    return [0, *(ends if last else ends[:-2])]


def certain(text: str, upto: int) -> int | None:
    """The first place where a pre-token starts whatever is before it: a blank between others than white space."""
    m = re.search(r"(?<=\S) (?=\S)", text[: upto + 2])
    return m.start() if m and m.start() <= upto else None


def chunked(text: str, chunk: int, overlap: int) -> list[tuple[int, bool, str]]:
    """(number, whether last, text) of overlapping chunks."""
    n = max(1, -(-len(text) // chunk))
    return [(k, k == n - 1, text[k * chunk : (k + 1) * chunk + overlap]) for k in range(n)]


def edge(number: int, last: bool, text: str, chunk: int, overlap: int) -> tuple[list[int], list[int], int | None]:
    """Boundaries in the overlap with the chunk before and in that with the next, both from the overlap's start; the first certain one."""
    found = boundaries(text, last)
    inside = lambda b: text[b : b + 1].isspace() and (not b or text[b - 1].isspace())  # noqa: E731  how a run is cut depends on its end
    return [b for b in found if b < overlap and not inside(b)], [b - chunk for b in found if b >= chunk], certain(text, overlap - 1) if number else 0


def columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    """A column for each field of the schema."""
    return [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)]


def run_over(df: DataFrame, names: list[str], schema: pa.Schema, ddl: str, fn: Callable[..., tuple]) -> DataFrame:
    """The columns of df with those that fn makes of the named ones, row by row within slices of Arrow batches."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                rows = [fn(*r) for r in zip(*(part.column(kept.index(c)).to_pylist() for c in names))]
                made = [pa.array(list(values), type=f.type) for values, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*kept, *schema.names])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + ddl)


IDS = pa.schema([("ids", pa.binary())])
CODED = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
CHECKED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(ids: bytes, name: str = RANKS) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, and digest of the bytes that they decode to."""
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, name)).hexdigest()


def encode_documents(docs: DataFrame, name: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit numbers; only if asked for) and their digests, of each row.

    Texts are encoded and decoded again in one Python task, so that an executor has one worker a core.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), "doc_id").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = pa.schema([("chunk", pa.int32()), ("last", pa.bool_()), ("part", pa.string()), *CODED])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                rows, given = whole.column(0).slice(at, SLICE), whole.column(1).slice(at, SLICE).to_pylist()
                single = [k for k, t in enumerate(given) if len(t) <= chunk]
                coded = [(x if with_ids else None, *digest(x, name)) for x in encode_all([given[k] for k in single], name)]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(single, pa.int32())), *columns([(0, True, None, *c) for c in coded], found)], names=["row", *found.names])
                for k, t in enumerate(given):
                    if len(t) > chunk:
                        cuts = [(*c, None, None, None, None) for c in chunked(t, chunk, overlap)]
                        yield pa.RecordBatch.from_arrays([rows.take(pa.array([k] * len(cuts), pa.int32())), *columns(cuts, found)], names=["row", *found.names])

    row_type = texts.schema["row"].dataType.simpleString()
    first = written(texts.mapInArrow(cut_up, f"row {row_type}, chunk int, last boolean, part string, ids binary, {CHECKED}"))
    short = first.filter("part IS NULL").select("row.doc_id", *CODED.names)
    chunks = first.filter("part IS NOT NULL").select("row", "chunk", "last", "part").repartition("row", "chunk")

    made = pa.schema([("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32())), ("sure", pa.int32())])
    ends = run_over(chunks, ["chunk", "last", "part"], made, "head array<int>, tail array<int>, sure int", lambda k, last, t: edge(k, last, t, chunk, overlap))
    ends = ends.select("row", "chunk", "head", "tail", "sure")  # small: the texts are joined again
    w = Window.partitionBy("row").orderBy("chunk")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
    ends = ends.withColumn("common", common)
    sure_at = F.max(F.when(F.col("sure").isNotNull(), F.col("chunk"))).over(w)
    broken_at = F.max(F.when(F.col("sure").isNull() & F.col("common").isNull(), F.col("chunk"))).over(w)
    ends = ends.withColumn("good", sure_at > F.coalesce(broken_at, F.lit(-1)))  # its pre-tokens are the text's from here on
    start = F.when(F.col("chunk") == 0, 0).when(F.lag("good").over(w), F.coalesce("common", "sure")).otherwise(F.col("sure"))
    ends = ends.withColumn("start", F.when(F.col("good"), start))
    ends = ends.withColumns({"piece": F.count("start").over(w), "until": F.lead("start").over(w)}).select("row", "chunk", "start", "until", "piece")

    until = f"{chunk} + coalesce(until, 0)"  # the overlap holds at least one character after it
    stitched = chunks.join(ends, ["row", "chunk"], "left").select(  # left, as an inner join filters its side for keys and then reads the texts anew
        "row", "chunk", "piece",
        F.expr(f"substring(part, coalesce(start, 0) + 1, CASE WHEN last THEN length(part) ELSE {until} - coalesce(start, 0) END)").alias("part"),
        F.expr(f"CASE WHEN last THEN '' ELSE substring(part, {until} + 1, 1) END").alias("follow"),
    )
    whole = stitched.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "part", "follow"))).alias("parts"))  # one chunk, save where none resynchronises
    pieces = whole.select("row", "piece", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("part"), F.element_at("parts", -1)["follow"].alias("follow"))
    coded = run_over(pieces, ["part", "follow"], IDS, "ids binary", lambda t, c: (encode_part(t, c, name),)).select("row", "piece", "ids")
    rows = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    long_ids = rows.select("row.doc_id", joined.alias("ids"))
    long = run_over(long_ids, ["ids"], pa.schema(list(CODED)[1:]), CHECKED, lambda ids: digest(ids, name))
    out = short.unionByName(long)
    return out if with_ids else out.drop("ids")


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests, of each row of docs."""
    return encode_documents(docs)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
SQL: dict[str, str] = {}

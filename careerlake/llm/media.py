"""Texts kept as lossless WebP pictures.

`store_media` makes a media column; `read_media` decodes one and describes what it holds. A null text counts as empty; equal texts
give equal media. A very long text is one picture, coded and decoded in spans, in memory in proportion to its length; one of over
16384 ** 2 bytes, more than a picture of the format holds, is several, one file behind the other in one value. Repeated rows and repeated or null ids stay, row for
row; an empty table gives an empty result; no columns but the named ones are read. No choices are made that ties could affect.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerlake.llm import webp
from careerlake.llm.common import ship, table

BLOCK = 64
#: Bytes of a picture at most, a multiple of BLOCK.
PICTURE = webp.SIDE**2
DESCRIBED = (
    T.StructType()
    .add("media_bytes", "long")
    .add("media_sha256", "string")
    .add("payload_sha256", "string")
    .add("tail_crc32", "long")
    .add("width", "integer")
    .add("height", "integer")
    .add("feature", "string")
)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def pictures(payload: bytes, most: int = PICTURE) -> bytes:
    """One picture of the payload, or of each `most` bytes of it, one file behind the other."""
    return b"".join(webp.encode(payload[at : at + most]) for at in range(0, len(payload), most))


def files(media: bytes) -> Iterator[bytes]:
    """The files that pictures() put together, by the sizes in their heads."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] != b"RIFF" or at + size > len(media):
            raise ValueError("not a row of WebP files")
        yield media if size == len(media) else media[at : at + size]
        at += size


def described(media: bytes, size: int) -> tuple:
    """What DESCRIBED names, of the first `size` samples of the media; the width is the widest picture's, heights are added."""
    whole, width, height, left, total, tail = hashlib.sha256(), 0, 0, size, 0, b""
    bins = np.zeros(16, np.int64)
    for file in files(media):
        across, down, pixels = webp.decode(file)
        samples = (pixels[:left] >> np.uint32(8)).astype(np.uint8)
        payload = samples.tobytes()
        whole.update(payload)
        bins += np.bincount(samples >> 4, minlength=16)
        width, height, left, total, tail = max(width, across), height + down, left - len(payload), total + int(samples.sum(dtype=np.int64)), (tail + payload[-BLOCK:])[-BLOCK:]
    if left:
        raise ValueError("fewer samples than were stored")
    feature = f"{width}x{height} mean={total / size:.4f} bins={','.join(map(str, bins.tolist()))}"
    return len(media), hashlib.sha256(media).hexdigest(), whole.hexdigest(), zlib.crc32(tail), width, height, feature


@F.pandas_udf(T.BinaryType())
def to_media(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([pictures(padded((t or "").encode()), int(n)) for t, n in zip(texts, most)], dtype=object)


@F.pandas_udf(DESCRIBED)
def describe(media: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([described(m, n) for m, n in zip(media, sizes)], columns=DESCRIBED.names)


def store_media(df: DataFrame, text: str = "text", media: str = "media", most: int = PICTURE) -> DataFrame:
    """df with n_bytes, payload_bytes and the picture of each text, or pictures of `most` bytes each; these names replace columns of theirs."""
    ship(df.sparkSession)
    n = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    size = F.greatest(F.lit(BLOCK), F.ceil(n / BLOCK) * BLOCK).cast("long")
    return df.withColumns({media: to_media(F.coalesce(F.col(text), F.lit("")), F.lit(most)), "n_bytes": n, "payload_bytes": size})


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id, sizes, checks of the payload as read back, and features of the picture."""
    ship(df.sparkSession)
    found = df.select("doc_id", "n_bytes", "payload_bytes", describe(F.col(media), F.col("payload_bytes")).alias("__m"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "__m.*")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op1_media_columns": op1_media_columns}
SQL: dict[str, str] = {}

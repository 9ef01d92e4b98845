"""The corpus pipeline: each stage takes and returns documents, written as Parquet in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from careerlake.llm import bpe, mixing, rules, secrets, simhash
from careerlake.llm.common import shared_dir, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality-rules", rules.keep_good),
    ("near-duplicates", simhash.keep_first),
    ("secrets", secrets.redact_secrets),
    ("mixing", mixing.sample_mixture),
    ("byte-bpe", bpe.encode_corpus),
]
#: The stages hash, merge byte pairs and iterate, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A null text counts as empty: it has no words, so the quality rules drop it. Rows with a null id stay as long as others do, and count
    last where one of a group of near-duplicates is chosen. Of repeated rows and of near-duplicates one stays. Very long texts are worked on
    whole. Columns besides doc_id, text, lang, source and n_chars are kept as they are, whatever their names, up to the last stage, which
    gives doc_id, ids and their digests. An empty table gives an empty result. Ties: a posterior of 0.5 keeps a text, a draw equal to its
    probability doesn't.
    """
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs

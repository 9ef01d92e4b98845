"""How often or how much is done, where results alone don't show it."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from careerlake.conf import DEFAULT
from careerlake.operators import lines, taxonomy
from careerlake.plans import flows
from careerlake.streaming import streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Counted:
    """A state or handle that counts what is asked of it."""

    def __init__(self, value=None):
        self.value, self.asked = value, []

    def __getattr__(self, name):
        def call(*args):
            self.asked.append(name)
            if name == "exists":
                return True
            if name in ("clear", "appendList"):
                self.value = [*(args[0] if args else [])]
            if name == "get":
                return iter(self.value) if isinstance(self.value, list) else self.value

        return call


def test_states_are_asked_once_a_batch_and_not_at_each_frame(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", lambda self, processor, *_: made.append(processor))
    streams.frames(streams.arriving(spark, str(tmp_path), "*.parquet", "conn long, seq long, ts timestamp, chunk string"))
    frames = made[0]
    frames.handle, frames.counts, frames.held = Counted(), Counted((3, 10, 5, "1")), Counted([('data: {"k": 1',)])
    chunks = [(1, k, 7, '}\n\ndata: {"k": 1') for k in range(50)]
    out = pd.concat(frames.handleInputRows((1,), iter([pd.DataFrame(chunks, columns=["conn", "seq", "at", "chunk"])]), None))
    assert out["frame_no"].tolist() == list(range(4, 54)) and out["total"].tolist()[-2:] == [59, 60]
    assert frames.held.asked == ["get", "clear", "appendList"] and len(frames.counts.asked) <= 3


def test_spans_are_shuffled_once_and_heights_looked_at_once(spark):
    made = flows.span_lines(spark, "/root/testdata/sf0.001")
    assert plan(made).count("Exchange") == 1 and "array_append" not in plan(made)


def test_lines_of_a_long_document_and_odd_heights(spark):
    """20,000 spans that drift by one; before, each added span copied all lines before it."""
    far, n = DEFAULT.same_line, 20_000
    rows = [(1, k, 0.0, float(k), str(k)) for k in range(n)]
    odd = [(2, 0, 0.0, 1.0, "a"), (2, 1, 0.0, None, "b"), (2, 2, 0.0, 2.0, "c"), (2, 3, 0.0, float("nan"), "d"), (2, 4, 0.0, 9e9, "e"), (3, 0, 0.0, None, "f"), (3, 1, 0.0, 9e9, "g")]
    began = time.monotonic()
    got = lines.span_lines(spark.createDataFrame(rows + odd, "doc_id long, place int, x0 double, y0 double, text string")).orderBy("doc_id", "line_no").collect()
    step = int(far) + 1
    assert [r["line"] for r in got if r["doc_id"] == 1] == [" ".join(map(str, range(k, min(k + step, n)))) for k in range(0, n, step)]
    assert [r["line"] for r in got if r["doc_id"] > 1] == ["a b c", "d", "e", "f g"]
    assert time.monotonic() - began < 30


def test_keys_of_labels_are_kept_before_they_become_rows(spark):
    r = random.Random(3)
    texts = ["", " ", "a", "a b", " a ", "\U0001f600 c++", *("".join(r.choice("ab1  .+\u00e9\U0001f600\n") for _ in range(r.randrange(60))) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.concat(taxonomy.tokens(F.col("t")), taxonomy.pairs(F.col("t"))).alias("k")).collect()
    every = frozenset(k for row in rows for k in row["k"])
    some = frozenset(sorted(every)[::2])
    assert len(every) > 100 and all(taxonomy.keys_in(row["t"], every) == set(row["k"]) and taxonomy.keys_in(row["t"], some) == some & set(row["k"]) for row in rows)
    docs = spark.createDataFrame([(1, "x C++ y"), (2, None), (3, "data  science.")], "doc_id long, text string")
    known = spark.createDataFrame([("c++", "k", []), ("data science", "k", [])], "canonical string, category string, synonyms array<string>")
    made = taxonomy.skills(docs, known)
    assert plan(made).count("ArrowEvalPython") == 1
    assert sorted((x["doc_id"], x["canonical"]) for x in made.collect()) == [(1, "c++"), (3, "data science")]

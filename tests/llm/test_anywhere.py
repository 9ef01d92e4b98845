"""Operators on a caller's own rows, in a session that began elsewhere and knows nothing of the library's folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from careerlake.llm import bpe, classifier, divergence, media, rules, secrets, simhash, templates, token_counts
docs = spark.createDataFrame([(k, "some words of text number %d " % k * 20, "en", "web") for k in range(8)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
pages = spark.createDataFrame([(k, "http://a.example/", "<body><div class=x>menu</div><article><p>text %d</article></body>" % k) for k in range(4)], "page_id long, url string, html string")
made = [templates.extract(pages), media.read_media(media.store_media(docs)), classifier.score_quality(docs, labels), rules.quality_rules(docs), secrets.secrets(docs), simhash.near_duplicates(docs), token_counts.token_counts(docs), divergence.audit(docs, 2), bpe.encode_documents(docs)]
print("ROWS", [x.count() for x in made if len(x.collect())])
"""


def test_operators_run_where_the_library_is_not_installed(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    # workers of a cluster of its own processes start in Spark's folder, not in this one
    home = tmp_path / "home"
    import pyspark

    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env["SPARK_HOME"] = str(home)
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS [4, 8, 8, 8, 8, 8, 8, " in got.stdout, got.stdout[-1500:] + got.stderr[-3000:]

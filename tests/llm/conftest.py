import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, row int, `__text` string, score double"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmno", k=r.randint(1, 9))) for _ in range(300)] + ["é", "naïve", "数据", "🙂", "it's", "100", "AKIA" + "Z9" * 9, "ab12" * 7]
    texts = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(30)]
    texts += [texts[0], texts[0], None, "", " \n\t ", "word", " ", " ".join(r.choices(words, k=40_000)), "x" * 100_000, "a  b\r\n\r\n  c", "released under the MIT License\ncc by 4 0", "password = hunter22hunter22 token:abc api_key='abcdef'"]
    rows = [(k, t, "en", "web", len(t or ""), k, k, "t", 0.5) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (7, "other text of id 7", "de", None, 3, 1, 1, "", 0.1)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

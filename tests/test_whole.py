"""Queries whose SQL cuts what is read, on small tables of our own."""

from careerlake import registry


def query(spark, folder, name, **tables):
    for t, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]


def test_all_lines_are_read(spark, tmp_path):
    made = [f"line {k}" for k in range(20)]
    made[15] = "Professional Summary"
    docs = {"documents": ([(1, "\n".join(made), "web")], "doc_id long, text string, source string")}
    assert sorted((r[5], r[2], r[4]) for r in query(spark, tmp_path, "doc_sections", **docs)) == [(1, "experience", 1), (5, "skills", 2), (10, "skills", 2), (16, "summary", 1)]
    assert query(spark, tmp_path, "doc_section_order") == [(1, "skills", "summary")]
    assert query(spark, tmp_path, "doc_completeness") == [(1, 55.0)]
    assert query(spark, tmp_path, "doc_age_bias") == [(1, "birth", "")] * 20
    assert len(query(spark, tmp_path, "bullet_stats")) == 20


def test_each_document_gets_an_item(spark, tmp_path):
    docs = [(k, t, "web") for k, t in [(0, "the and"), (1, "thing"), (2, "nothing at all"), (3, "with the"), (7, "and"), (8, None)]]
    made = {"documents": (docs, "doc_id long, text string, source string"), "benchmark": ([(5, "the thing and"), (9, "xyz"), (11, "with")], "item_id long, text string")}
    got = query(spark, tmp_path, "keyword_coverage", **made)
    # items by remainder: 0 and 3 get "the thing and", 1 and 7 "xyz", 2 and 8 "with"
    assert sorted(got) == [(0, 67, "thing"), (1, None, ""), (2, 0, "with"), (3, 33, "and,thing"), (7, None, ""), (8, 0, "with")]
    got = query(spark, tmp_path, "jd_tailoring")
    assert sorted(got) == [(0, 0.5, 1.0, 1), (1, 1.0, 1.0, 0), (2, 1.0, 0.0, 1), (3, 0.5, 0.0, 2), (7, 1.0, 1.0, 0), (8, 1.0, 0.0, 1)]


def test_each_misspelling_of_each_document_is_given(spark, tmp_path):
    texts = ["house cat internationalising " * 20, "a houze cet", "a houze cet", "houze houze, internationalizing", "Houze zebra no ct"]
    got = query(spark, tmp_path, "doc_spelling", documents=([(k, t, "web") for k, t in enumerate(texts)], "doc_id long, text string, source string"))
    assert sorted(g[:3] for g in got) == [(1, "cet", "cat"), (1, "houze", "house"), (2, "cet", "cat"), (2, "houze", "house"), (3, "houze", "house"), (3, "internationalizing", "internationalising")]
    assert {g[3] for g in got} == {1}  # lines with the word


def test_fuzzy_matches_are_runs_of_whole_words(spark, tmp_path):
    texts = ["x thing tion y", "and ering", "thingtionabcdefghijk", "thíngtion", "élanthingtionn", "none"]
    got = query(spark, tmp_path, "fuzzy_skill_match", documents=([(k, t, "web") for k, t in enumerate(texts)], "doc_id long, text string, source string"))
    assert sorted(got) == [(0, "thingtion", "thing tion", 94.74), (1, "andering", "and ering", 94.12), (3, "thingtion", "thíngtion", 88.89)]


def test_order_of_words_and_length_of_names(spark):
    from careerlake.operators import match

    words = spark.createDataFrame([(1, "learning machin"), (2, "internationalizing"), (3, "c")], "doc_id long, word string")
    names = spark.createDataFrame([("machine learning",), ("internationalising",)], "name string")
    assert sorted(tuple(r) for r in match.fuzzy(words, names).collect()) == [(1, "machine learning", "learning machin", 96.77), (2, "internationalising", "internationalizing", 94.44)]


def test_all_jobs_are_sorted(spark, tmp_path):
    parts = [(k, f"part {k}", "b", "steel", k % 50, 900.0 + k) for k in range(1, 151)]
    got = query(spark, tmp_path, "job_pay_sort", part=(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    paid = lambda k: int(f"{900 + k}{k % 90}") if k % 5 else 0
    assert [(r[0], r[2]) for r in got] == sorted(((k, paid(k)) for k in range(1, 151)), key=lambda x: (-x[1], x[0]))


def test_any_customer_can_lead_and_orphans_have_no_customer(spark, tmp_path):
    made = {
        "customer": ([(4, 1, 90.0), (5, 1, 80.0), (8, 1, 70.0), (13, 1, 60.0), (12, 2, -5.0)], "c_custkey long, c_nationkey long, c_acctbal double"),
        "nation": ([(1, "A"), (2, "B")], "n_nationkey long, n_name string"),
        "orders": ([(1, 4), (2, 13), (3, 99), (4, 12)], "o_orderkey long, o_custkey long"),
    }
    assert sorted(query(spark, tmp_path, "leaderboard_topk", **made)) == [("A", 4, 90.0, 1), ("A", 5, 80.0, 2), ("A", 8, 70.0, 3)]
    assert query(spark, tmp_path, "fk_orphans") == [(3, 99)]

"""Cases out of a review: large groups, words that are operators, signs of noughts, far points."""

import time

from pyspark.sql import functions as F

from plenum.functions import rules, vectors


def test_long_list_is_sorted_once(spark):
    items = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.concat(F.when(i % 2 == 0, "a").otherwise("A"), (i % 5000).cast("string")))
    began = time.time()
    got = spark.range(1).select(rules.distinct_ignoring_case(items).alias("l")).collect()[0].l
    assert got == [("a" if i % 2 == 0 else "A") + str(i) for i in range(5000)]
    assert time.time() - began < 30


def test_round_keeps_the_sign_of_nought(spark):
    d = spark.createDataFrame([(-1e-7,), (0.0,), (-0.0000251,), (1.5e-5,), (None,)], "x double")
    assert [repr(r[0]) for r in d.select(vectors.rounded(F.col("x"), 5)).collect()] == ["-0.0", "0.0", "-3e-05", "2e-05", "None"]


def test_or_as_a_word_of_a_text(spark, tmp_path):
    from plenum.plans import text_queries

    spark.createDataFrame([(1, "or apple pear"), (2, "apple pear")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "Or apple pear x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for q, want in ((text_queries.fts_phrases, [(2, 1, 1.0, 1), (2, 2, 0.5, 2)]), (text_queries.fts_next_page, [])):
        assert sorted(tuple(r) for r in q(spark, str(tmp_path)).select("item_id", "doc_id", "score", "place").collect()) == want


def test_first_holding_and_labels_inside_are_the_pairs_summed_up(spark):
    from plenum.operators import intervals as I

    p = spark.createDataFrame([(m, i, "AB"[i % 2], float(i * 7 % 23)) for m in (1, 2) for i in range(40)], "m int, i int, label string, t double")
    s = spark.createDataFrame([(m, k, float(k * 5 % 17), float(k * 5 % 17 + k * 3 % 8)) for m in (1, 3) for k in range(12)], "m int, k int, s double, e double")
    pairs = I.point_in_interval(p, s, ["m"], "t", "s", "e", 4.0)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(I.first_holding(p, s, ["m"], "t", "s", "e", "k", "k").select("m", "i", "k")) == rows(pairs.groupBy("m", "i").agg(F.min_by("k", F.struct("s", "k"))))
    assert rows(I.labels_inside(p, s, "m", "k", "t", "s", "e")) == rows(pairs.groupBy("m", "k", "label").agg(F.count("*"), F.min("t")))


def test_intervals_over_one_another_move_each_point_once(spark):
    from plenum.operators import intervals as I

    p = spark.range(20_000).select(F.lit(1).alias("m"), F.col("id").alias("i"), F.lit("A").alias("label"), (F.col("id") / 100).alias("t"))
    s = spark.range(20_000).select(F.lit(1).alias("m"), F.col("id").alias("k"), F.lit(0.0).alias("s"), F.lit(1000.0).alias("e"))
    began = time.time()
    assert I.first_holding(p, s, ["m"], "t", "s", "e", "k", "k").where("k = 0").count() == 20_000
    assert I.labels_inside(p, s, "m", "k", "t", "s", "e").agg(F.sum("n")).collect()[0][0] == 400_000_000
    assert time.time() - began < 40


def test_names_of_a_small_alphabet_meet_few_others(spark):
    from plenum.operators import similar

    digits = lambda n, step: spark.range(n).select(F.translate(F.lpad((F.col("id") * step % 1000000).cast("string"), 6, "0"), "0123456789", "abdeiklnor").alias("x"))
    a, b = digits(200, 2503).withColumnRenamed("x", "a"), digits(20_000, 7919).withColumnRenamed("x", "b")
    began = time.time()
    got = {(r.a, r.b) for r in similar.similar_names(a, b, "a", "b").collect()}
    assert time.time() - began < 60
    import difflib
    some = [r.a for r in a.orderBy("a").limit(5).collect()]
    assert {p for p in got if p[0] in some} == {(x, r.b) for x in some for r in b.collect() if difflib.SequenceMatcher(None, x, r.b).ratio() >= 0.8}


def test_shared_seconds_are_the_sum_over_all_pairs():
    import numpy as np

    from plenum.operators.sequential import shared_seconds

    r = np.random.default_rng(1)
    for n in (1, 7, 40):
        a, b = (np.stack([s, s + np.round(r.random(n) * 30, 3)], 1) for s in np.round(r.random((2, n)) * 300, 3))
        pairs = np.maximum(0, np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0])).sum()
        assert abs(shared_seconds(a, b) - pairs) < 1e-6
    assert shared_seconds(np.array([[0.0, 1.0]]), np.array([[1.0, 2.0]])) == 0.0 == shared_seconds(a[:0], a)
    many = np.stack([np.arange(100_000.0), np.arange(100_000.0) + 50], 1)  # a table of all pairs would take 80 GB
    assert shared_seconds(many, many) == 50 * 100_000 + 2 * sum((50 - d) * (100_000 - d) for d in range(1, 50))


def test_record_turns_reads_whole_nations(spark):
    from plenum.plans import record_queries

    got = record_queries.record_turns(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert {r.c_nationkey: r.n for r in got.groupBy("c_nationkey").agg(F.count("*").alias("n")).collect()} == {r.c_nationkey: r.n for r in n.groupBy("c_nationkey").agg(F.count("*").alias("n")).collect()}

"""Steps that read their input once: captions, words and turns, strips, folded texts, indexed words."""

import random
import re

from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.operators import intervals as I
from plenum.operators import search
from plenum.sources import captions as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_captions_are_worked_through_once_for_their_turns(spark):
    cues = spark.range(40).select((F.col("id") % 2).alias("meeting"), F.floor(F.col("id") / 2).alias("cue"), (F.floor(F.col("id") / 2) * 2.0).alias("start"), (F.floor(F.col("id") / 2) * 2.0 + 2).alias("end"), F.array(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("lines"))
    turns = spark.range(2).select(F.col("id").alias("meeting"), F.lit(5).alias("segment_id"), F.lit(0.0).alias("start_time"), F.lit(6.0).alias("end_time"))
    got = C.align(cues, turns)
    assert plan(got).count("FlatMapGroupsInPandas") == 1
    assert {tuple(r) for r in got.collect()} == {(0, 5, "w0 w2 w4"), (1, 5, "w1 w3 w5")}


def test_words_of_turns_against_all_pairs(spark):
    r = random.Random(5)
    time = lambda most: round(r.random() * most, 1)
    words = [(m, i, s, s + r.choice([0.0, 0.3, 1.0, 9.0, -1.0])) for m in (1, 2, 3) for i in range(60) for s in [time(60)]] + [(1, 99, None, 3.0)]
    turns = [(m, i, s, s + r.choice([0.0, 0.5, 0.7, 3.0, 8.0, 25.0])) for m in (1, 2, 4) for i in range(9) for s in [time(60)]]
    want = {}
    for m, w, s, e in words:
        want[m, w] = (None, None)
        if s is None:
            continue
        mid, mine = (s + e) / 2, [t for t in turns if t[0] == m and t[3] > t[2]]
        share = lambda t: max(0.0, min(e, t[3]) - max(s, t[2]))  # noqa: B023, E731
        inside = [(t[2], t[1]) for t in mine if t[2] <= mid < t[3] and (t[3] - t[2] >= 0.8 or share(t) * 2 >= e - s)]
        beside = [(round(share(t), 6), -t[2], -t[1]) for t in mine if t[3] - t[2] >= 0.8 and e > s and share(t) > 0]
        if inside:
            want[m, w] = (min(inside)[1], "middle")
        elif beside:
            want[m, w] = (-max(beside)[2], "overlap")
    w = spark.createDataFrame(words, "meeting int, word_id int, word_start double, word_end double").withColumn("word", F.concat(F.lit("w"), "word_id"))
    t = spark.createDataFrame(turns, "meeting int, segment_id int, start_time double, end_time double")
    for width in (7.0, 600.0):
        got = I.assign_words(w, t, width=width, keep=["word"])
        assert {(r.meeting, r.word_id): (r.segment_id, r.tier) for r in got.collect()} == want
        assert got.count() == len(words) and got.where("word = 'w' || word_id").count() == len(words)
        assert plan(got).count("Scan ExistingRDD") == 2
    assert {"middle", "overlap", None} == {v[1] for v in want.values()}


def test_rolled_lines_as_before(spark):
    d = spark.createDataFrame([(["A b,", "a B c", "<i>C!</i> &amp; d"],), ([],), (None,), (["-- x", "-- y"],)], "l array<string>")
    assert [r[0] for r in d.select(C.merge_rolling(F.col("l"))).collect()] == ["A b, c & d", "", None, "-- x -- y"]


def test_strips_merge_a_labels_turns_before_seconds(spark):
    # 40,000 turns over the same 500 seconds: one by one these would be 20 million rows
    many = spark.range(40_000).select(F.lit(1).alias("meeting"), F.lit("SA").alias("label"), (F.col("id") % 3 / 4.0).alias("start_time"), (F.col("id") % 3 / 4.0 + 500).alias("end_time"))
    few = spark.createDataFrame([(1, "SB", 498.5, 503.0), (1, "SB", 502.0, 502.5), (1, "SC", 620.0, 621.0), (1, "SC", 700.0, 700.0), (2, "SA", 3.0, 3.5)], "meeting int, label string, start_time double, end_time double")
    got = I.activity_strips(many.unionByName(few), F.col("start_time"), 300)
    want = {(1, 0): "A" * 300, (1, 1): "A" * 198 + "***" + "BB" + "." * 97, (1, 2): "." * 20 + "C" + "." * 279, (2, 0): "...A" + "." * 296}
    assert {(r.meeting, r.window): r.strip for r in got.collect()} == want
    below = plan(got)
    assert 0 < below.index("Generate explode(sequence(first") < below.index("Window [max(last")


def test_texts_are_folded_once_for_names_and_terms(spark):
    d = spark.createDataFrame([("Town–Hall", "JOSE\u0301 \t Muñoz's\x0b“talk” İ2", 100), (None, "josé munoz", 100), ("x", None, None), ("jose", "munozs Q & A", 2000)], "t string, d string, n int")
    got = d.select(X.prefilter(F.col("t"), F.col("d"), F.col("n"), F.array(F.lit("Cher"), F.lit("José Muñoz"), F.lit(None))).alias("v"), X.fold(F.col("d")).alias("f"))
    assert plan(got.select("v.passes", "v.matched", "v.reason")).count("translate(") <= 3
    assert [(r.v.passes, r.v.matched, r.v.duration_signal, r.v.reason, r.f) for r in got.collect()] == [
        (True, ["José Muñoz"], "short", "name match", "jose munoz s talk i2"),
        (False, ["José Muñoz"], "short", "short clip without event term", "jose munoz"),
        (False, [], "unknown", "no tracked candidate name", ""),
        (False, [], "long", "no tracked candidate name", "munozs q a"),
    ]


def test_documents_are_ranked_where_their_words_are_counted(spark):
    r = random.Random(3)
    texts = [(i, [r.choice("abcdefgh") for _ in range(r.randint(0, 12))]) for i in range(60)]
    asked = [(q, w) for q in range(7) for w in r.sample("abcxyz", 3)]
    docs = spark.createDataFrame(texts, "doc int, ws array<string>")
    queries = spark.createDataFrame(asked, "q int, word string")
    index = search.token_table(docs, "doc", F.col("ws"), queries, 3)
    assert {tuple(x) for x in index.collect()} == {(i, w, ws.count(w), len(ws)) for i, ws in texts for w in set(ws) & {w for _, w in asked}}
    got = search.rank(queries, index, "q", "doc", 4)
    want = set()
    for q in range(7):
        words = [w for p, w in asked if p == q]
        hits = [(-round(sum(ws.count(w) / len(ws) for w in words), 6), -len(set(ws) & set(words)), i) for i, ws in texts if set(ws) & set(words)]
        want |= {(q, i, -s, -n, place) for place, (s, n, i) in enumerate(sorted(hits)[:4], 1)}
    assert {(x.q, x.doc, x.score, x.n_words, x.place) for x in got.collect()} == want
    assert "hashpartitioning(q#" in plan(got) and not re.search(r"hashpartitioning\((q#\d+L?, doc#|doc#\d+L?, (q|word)#)", plan(got))
    whole = search.token_table(docs, "doc", F.col("ws"))
    assert {tuple(x) for x in search.rank(queries, whole, "q", "doc", 4).select("q", "doc", "score", "n_words", "place").collect()} == want

"""Operators against plain restatements on small cases, and edge cases."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plenum.functions import text as X
from plenum.functions.graph import components
from plenum.functions.vectors import cosine
from plenum.operators import gate, identity, intervals, scoring, search, sequential, sessions, upsert
from plenum.operators.similar import alike

TURN = "meeting int, segment_id long, label string, start_time double, end_time double"


def turns(spark, rows):
    return spark.createDataFrame(rows, TURN)


def random_turns(seed, n=60, labels="AB"):
    r = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += r.choice([0.2, 0.5, 1.0, 3.0])
        out.append((i % 2, i, r.choice(labels), t, t + r.choice([0.1, 0.4, 2.0, 5.0])))
    return out


@pytest.mark.parametrize("extend", ["max", "last"])
def test_merge_adjacent_is_the_fold(spark, extend):
    rows = random_turns(1)
    want = []
    for m in (0, 1):
        held = []
        for _, _, label, s, e in (x for x in rows if x[0] == m):
            if held and held[-1][0] == label and s - held[-1][2] < 2.0:
                held[-1][2] = max(held[-1][2], e) if extend == "max" else e
            else:
                held.append([label, s, e])
        want += [(m, i, *h) for i, h in enumerate(held)]
    got = sessions.merge_adjacent(turns(spark, rows), 2.0, extend).collect()
    assert sorted((r.meeting, r.segment_id, r.label, r.start_time, r.end_time) for r in got) == sorted(want)


def test_sessions_take_empty_tables(spark):
    none = turns(spark, [])
    assert sessions.merge_adjacent(none, 1.0).collect() == []
    assert sessions.speaker_runs(none).collect() == []
    assert sessions.trim_overlaps(none).collect() == []
    assert intervals.covered_seconds(none, ["meeting"]).collect() == []


def test_trim_overlaps_is_the_fold(spark):
    rows = random_turns(2)
    got = {r.segment_id: r.start_time for r in sessions.trim_overlaps(turns(spark, rows)).collect()}
    for m in (0, 1):
        reach = float("-inf")
        for _, i, _, s, e in (x for x in rows if x[0] == m):
            assert got[i] == pytest.approx(min(reach, e) if s < reach else s, abs=1e-3)
            reach = max(reach, e)


def test_windows(spark):
    d = spark.createDataFrame([(1, 250.0), (2, 230.0), (3, 40.0), (4, None), (5, 200.0)], "meeting int, duration double")
    got = {}
    for r in sessions.tumbling_windows(d, 100.0).orderBy("meeting", "window").collect():
        got.setdefault(r.meeting, []).append((r.window_start, r.window_end))
    assert got == {1: [(0, 100), (100, 200), (200, 250)], 2: [(0, 100), (100, 230)], 3: [(0, 40)], 5: [(0, 100), (100, 200)]}
    s = sessions.sliding_windows(d.where("meeting = 1"), 100.0, 20.0).orderBy("window").collect()
    assert [(r.window_start, r.window_end) for r in s] == [(0, 100), (80, 180), (160, 250)]
    assert [(r.owned_from, r.owned_to) for r in s] == [(0, 90), (90, 170), (170, 250)]


def test_point_in_interval_and_overlap_are_the_nested_loops(spark):
    r = random.Random(4)
    iv = [(i, 0, s := r.uniform(-20, 50), s + r.choice([0.0, 0.3, 7.0, 40.0])) for i in range(30)]
    pt = [(i, 0, r.uniform(-30, 100)) for i in range(60)]
    ivd = spark.createDataFrame(iv, "i int, m int, s double, e double")
    got = intervals.point_in_interval(spark.createDataFrame(pt, "p int, m int, t double"), ivd, ["m"], "t", "s", "e", 5.0)
    assert sorted((x.p, x.i) for x in got.collect()) == sorted((p, i) for p, _, t in pt for i, _, s, e in iv if s <= t < e)
    other = ivd.toDF("j", "m", "u", "v")
    got = intervals.overlapping(ivd, other, ["m"], ("s", "e"), ("u", "v"), 5.0)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((a[0], b[0]) for a in iv for b in iv if min(a[3], b[3]) > max(a[2], b[2]))


def test_as_of_and_nulls(spark):
    p = spark.createDataFrame([(1, 1, 5.0), (2, 1, 0.5), (3, 2, 9.0)], "id int, m int, t double")
    s = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b"), (1, 7.0, "c")], "m int, since double, v string")
    got = {r.id: r.v for r in intervals.as_of(p, s, ["m"], "t", "since", "v", "v").collect()}
    assert got == {1: "b", 2: None, 3: None}


def test_assign_words_tiers(spark):
    t = turns(spark, [(1, 1, "A", 0.0, 2.0), (1, 2, "B", 2.0, 2.3), (1, 3, "A", 10.0, 12.0)])
    w = spark.createDataFrame([(1, 1, 0.5, 0.9), (1, 2, 1.95, 2.35), (1, 3, 9.0, 10.5), (1, 4, 5.0, 5.4)], "meeting int, word_id long, word_start double, word_end double")
    got = {r.word_id: (r.segment_id, r.tier) for r in intervals.assign_words(w, t).collect()}
    assert got == {1: (1, "middle"), 2: (2, "middle"), 3: (3, "overlap"), 4: (None, None)}


def test_majority(spark):
    v = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None), (4, "a"), (4, None), (4, None)], "k int, c string")
    got = {r.k: (r.status, r.c) for r in identity.majority(v, ["k"], "c").collect()}
    assert got == {1: ("resolved", "a"), 2: ("ambiguous", None), 3: ("unresolved", None), 4: ("ambiguous", None)}


def test_dedupe_second_pass_sees_the_first(spark):
    rows = [(1, 1, "S1", "Ann", "p1", 0.9), (1, 2, "S2", "ann2", "p1", 0.8), (1, 3, "S3", "Ann", "p2", 0.5), (1, 4, "S4", None, None, 0.1)]
    d = spark.createDataFrame(rows, "meeting int, ordinal int, label string, name string, person string, confidence double")
    got = {r.label: (r.name, r.person, r.needs_review) for r in identity.dedupe_identities(d).collect()}
    assert got == {"S1": ("Ann", "p1", False), "S2": (None, None, True), "S3": (None, None, True), "S4": (None, None, False)}


def test_cosine_guards(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.c for r in d.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1:] == [None] * 4


def test_components(spark):
    nodes = spark.range(8).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(3, 5), (5, 7), (1, 2)], "a long, b long")
    got = {r.node: r.component for r in components(nodes, edges, "n", "a", "b").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6, 7: 3}


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id int, v string")
    s = spark.createDataFrame([(2, "x"), (3, "y"), (4, "z")], "id int, v string")
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(upsert.upsert(t, s, ["id"])) == [(1, "a"), (2, "x"), (3, "y"), (4, "z")]
    assert [r[0] for r in rows(upsert.insert_if_absent(t.where("id = 1"), s.union(s), ["id"], ["v"]))] == [1, 2, 3, 4]
    assert rows(upsert.fill_only(t, s, ["id"], ["v"])) == [(1, "a"), (2, "x"), (3, "y")]
    bag = lambda xs: spark.createDataFrame([(x,) for x in xs], "r string")
    assert sorted(map(tuple, upsert.multiset_drift(bag("aab"), bag("abcc")).collect())) == [("a", "missing", 1), ("c", "extra", 2)]


def test_boundaries_and_prf(spark):
    d = spark.createDataFrame([([2, 5, 9], [3, 4, 10]), ([], [1]), ([5], [])], "g array<int>, c array<int>")
    got = [r.m for r in d.select(scoring.matched_boundaries(F.col("g"), F.col("c")).alias("m")).collect()]
    assert got == [3, 0, 0]
    r = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, None)], "g int, p int")
    c = scoring.confusion(r, F.col("g") == 1, F.col("p") == 1, []).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.failed, c.precision) == (1, 1, 1, 0, 1, 0.5)


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 2), (2, 5), (5, 5)]:
        g = r.random((n, m)).round(2)
        k = min(n, m)
        best = max(sum(g[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.permutations(range(m), k))
        found = sequential.assignment(g)
        assert len(found) == k and sum(g[i, j] for i, j in found) == pytest.approx(best)


def test_diarization_error(spark):
    ref = turns(spark, [(1, 1, "A", 0.0, 10.0), (1, 2, "B", 10.0, 20.0)])
    hyp = turns(spark, [(1, 1, "x", 0.0, 12.0), (1, 2, "y", 12.0, 18.0)])
    r = sequential.diarization_error(ref, hyp).first()
    assert (r.speech, r.correct, r.der) == (20.0, 16.0, 0.2)  # 2 s confused, 2 s missed
    assert sequential.diarization_error(ref, hyp.limit(0)).first().der == 1.0


def test_stitch_keeps_speakers(spark):
    rows = [(1, w, "a" if (who == "A") == (w % 2 == 0) else "b", s, e, None) for w, (lo, hi) in enumerate([(0, 10), (8, 18), (16, 26)]) for who, s, e in [("A", float(i), i + 0.5) for i in range(26)] + [("B", i + 0.5, i + 1.0) for i in range(26)] if lo <= s < hi]
    d = spark.createDataFrame(rows, "meeting int, window long, local string, start_time double, end_time double, voice array<double>")
    got = {(r.window, r.local): r.global_label for r in sequential.stitch(d).collect()}
    assert got[0, "a"] == got[1, "b"] == got[2, "a"] != got[0, "b"] == got[1, "a"] == got[2, "b"]


def test_align_prefers_order():
    a = [{"x", "y"}, {"z", "w"}, {"q"}]
    b = [{"z", "w", "v"}, {"x", "y"}, {"q", "r"}]
    assert [(i, j) for i, j, _ in sequential.align_sets(a, b)] in ([(0, 1), (2, 2)], [(1, 0), (2, 2)])
    assert sequential.align_sets([], b) == [] and sequential.align_sets([{"x"}], [set()]) == []


def test_folds(spark):
    roll = "array<struct<yeas:int,nays:int>>"
    d = spark.createDataFrame([([(10, 2), (5, 5), (7, 1)], [(9, 2), (50, 1), (8, 1)])], f"r {roll}, a {roll}")
    assert d.select(sequential.match_in_order(F.col("r"), F.col("a"), 1)).first()[0] == [1, None, 3]
    d = spark.createDataFrame([([(0, 5), (3, 2), (4, 8), (2, 3), (None, 1), (6, 99)],)], "s array<struct<first:int,last:int>>")
    assert d.select(sequential.accept_spans(F.col("s"), F.lit(50))).first()[0] == [None, "order", None, "backwards", "missing", "range"]


def test_text_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(X.normalise(F.lit("  Dr. José-María "))) == "dr jos mar a"
    assert one(X.surname(F.lit("Council Member Jane  Adams Clerk"))) == "adams"
    assert one(X.surname(F.lit("Mayor"))) == "mayor"
    assert one(X.significant_tokens(F.lit("Council President Lee, Hon. J"))) == ["lee"]
    assert [one(X.parse_clock(F.lit(x))) for x in ("75", "1:15", "1:02:03.5", "1:75", "x", "1:2:3:4")] == [75.0, 75.0, 3723.5, None, None, None]
    assert one(X.srt_time(F.lit(3661.9999))) == "01:01:01,999"
    assert one(X.source_key(F.lit("https://www.Example.org/a/b/?utm_source=x&b=2&a=1&t=4#top"))) == "url:www.example.org/a/b?a=1&b=2"
    videos = ["https://youtu.be/ab_1?t=3", "http://m.youtube.com/watch?pp=1&v=ab_1", "https://music.youtube.com/live/ab_1/x", "https://youtube.com/v/ab_1"]
    assert {one(X.source_key(F.lit(v))) for v in videos} == {"youtube:ab_1"}
    assert [one(X.source_key(F.lit(v))) for v in (None, "  ", "/x/y.mp4", "https://youtube.com/about")] == ["", "", "file:/x/y.mp4", "url:youtube.com/about"]
    assert one(alike(F.lit("Smith"), F.lit("smyth"))) == pytest.approx(0.8)
    assert one(search.highlight(F.lit("A (b) a"), F.lit("a"))) == "[[[A]]] (b) [[[a]]]"
    assert one(X.strip_html(F.lit("<nav>x</nav><p>a&amp;b</p><!-- c --> d"))) == "a&b d"


def test_gate_tiers_and_verdicts(spark):
    methods = ["voice_profile", "voice_profile (far)", "voice_profile (returning_3)", "human_confirmed", "llm", "title_context", "crec", "", None]
    d = spark.createDataFrame([(i, m) for i, m in enumerate(methods)], "i int, m string")
    assert [r.t for r in d.orderBy("i").select(gate.tier(F.col("m")).alias("t")).collect()] == ["trusted", "trusted", "probable", "trusted", "unverified", "unverified", "unknown", "unknown", "unknown"]
    turns = [(1, "A", 0.0, 800.0), (1, "B", 800.0, 1000.0), (1, "C", 1000.0, 1050.0), (1, "M", 0.0, 5000.0), (2, "A", 0.0, 10.0), (2, "B", 10.0, 30.0), (3, "A", 5.0, 5.0)]
    people = [(1, "A", "Ann", "roll_call", None), (1, "B", "Bo", "voice_profile (returning_1)", None), (1, "C", "Cy", "llm", None), (1, "M", "Band", "human_review", "non_speaker"), (2, "A", None, "roll_call", None)]
    t = spark.createDataFrame(turns, "meeting int, label string, start_time double, end_time double")
    s = spark.createDataFrame(people, "meeting int, label string, name string, id_method string, status string")
    k = spark.createDataFrame([(1, "debate"), (2, None)], "meeting int, event_kind string")
    got = {r.meeting: r for r in gate.evaluate(t, s, k).collect()}
    assert (got[1].n_eligible, got[1].trusted_coverage, got[1].probable_coverage, got[1].effective_coverage, got[1].verdict) == (2, 0.8, 0.2, 0.9, "review")
    assert (got[2].n_eligible, got[2].unknown_coverage, got[2].verdict) == (2, 1.0, "failed") and got[3].verdict == "failed"


def test_prefilter_of_found_items(spark):
    rows = [
        ("José Muñoz at the DEBATE", None, 100), ("Jose  Munoz!", "clip", 100), ("Jose Munoz", "clip", None), ("Cher sings", "debate", 9000), ("Josep Munozo", "", 2000), (None, None, 500),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string, n int")
    got = [r.v for r in d.orderBy("i").select(X.prefilter(F.col("t"), F.col("d"), F.col("n"), F.array(F.lit("Cher"), F.lit("José Muñoz"))).alias("v")).collect()]
    assert [(g.passes, g.duration_signal) for g in got] == [(True, "short"), (False, "short"), (True, "unknown"), (False, "long"), (False, "long"), (False, "neutral")]
    assert got[0].matched == ["José Muñoz"] and got[1].reason == "short clip without event term"


def test_components_of_a_chain(spark):
    edges = spark.range(40).selectExpr("id as a", "id + 1 as b")
    nodes = spark.range(43).withColumnRenamed("id", "n")
    got = {r.node: r.component for r in components(nodes, edges, "n", "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {41: 41, 42: 42}


def test_what_a_step_settles_goes_with_it(spark):
    from plenum.functions.graph import forget, passing, settle

    with passing() as keep:
        a = settle(spark.range(5))
        b = keep(settle(a.where("id > 1")))
    where = spark._jvm.org.apache.hadoop.fs.Path
    there = [where(f).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where(f)) for d in (a, b) for f in d.inputFiles()[:1]]
    assert there == [False, True] and sorted(r.id for r in b.collect()) == [2, 3, 4]
    outside = settle(spark.range(2))
    assert outside.count() == 2
    forget(outside)

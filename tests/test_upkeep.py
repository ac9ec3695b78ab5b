"""Links, profile upkeep, chapters, row checks, and words at turn borders against a plain restatement."""

import random

from pyspark.sql import functions as F

from plenum.functions import checks
from plenum.operators import upkeep, words


def one(spark, e):
    return spark.range(1).select(e).first()[0]


def test_row_checks(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, checks.playback(s("HTTP://x.org/a.mp4"))) is None and one(spark, checks.playback(s(None))) is None
    assert tuple(one(spark, checks.playback(s(" https://x.org/a.b/c.MOV#t=1 ")))) == ("file", "https://x.org/a.b/c.MOV#t=1")
    assert [one(spark, checks.iso_date(s(x))) for x in ("2024-2-29", "2023-02-29", "2024-02-29T00", None)] == ["2024-02-29", None, None, None]
    assert [one(spark, checks.local_role(s(x), s("debate"))) for x in (None, "3", "0", "4", "99999999999", "!!", " Time Keeper ")] == ["candidate", "panelist", "candidate", "candidate", "candidate", "candidate", "time_keeper"]
    assert one(spark, checks.outcome_said(s("passed"), s("That is 7-2."))) and not one(spark, checks.outcome_said(s("pulled"), s("7-2"))) and not one(spark, checks.outcome_said(s("odd"), s(None)))
    assert one(spark, checks.reference_said(s("Ordinance 2026-3"), s("appropriation ordinance 2026-3; ordinance - 2026-3"))) and not one(spark, checks.reference_said(s("Ordinance 2026-3"), s("Appropriation\nOrdinance 2026-3")))
    assert not one(spark, checks.strong_match(s(" "), s("x"))) and one(spark, checks.strong_match(s("lee ANN"), s("Ann M Lee"))) and not one(spark, checks.strong_match(s("Host"), s("Hostettler")))
    assert one(spark, checks.whose_voice(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == "unembeddable"


def test_targets_and_relinks(spark):
    hits = spark.createDataFrame([("ann lee", "p1", None, "Ann Lee"), ("bo", "p2", "s2", "Bo"), ("bo", "p3", "s3", "Bo"), ("cy", "p4", "s4", "Cyrus")], "query string, person string, slug string, full_name string")
    asked = spark.createDataFrame([("ann lee", None), ("bo", None), ("cy", ""), ("bo", "p3"), ("di", "p9"), ("ed", None)], "query string, known string")
    got = {(r.query, r.action): (r.person, r.slug, r.full_name) for r in upkeep.confident_targets(asked, hits).collect()}
    none = (None, None, None)
    assert got == {("ann lee", "link"): ("p1", None, "Ann Lee"), ("bo", "review"): none, ("cy", "review"): none, ("bo", "link"): ("p3", "s3", "Bo"), ("di", "link"): ("p9", None, "di"), ("ed", "review"): none}
    speakers = spark.createDataFrame([(1, "A", "Ann Lee ", "p1", None), (1, "B", "ann lee", None, None), (1, "C", None, None, None)], "meeting int, label string, name string, person string, slug string")
    changed = upkeep.relink(speakers, spark.createDataFrame([("ANN LEE", "p1", None), (None, "p5", None)], "name string, person string, slug string"))
    assert [r.label for r in changed.collect()] == ["B"]


def test_profiles_fold_once(spark):
    p = spark.createDataFrame([("a", "A", None, ["m1"], 1), ("b", "B", "sb", ["m2", "m1"], 2), ("c", "C", None, [], 4), ("d", "D", "sd", ["m3"], 8)], "profile string, display_name string, slug string, meetings array<string>, segments int")
    m = spark.createDataFrame([("b", "a", None), ("c", "z", None), ("d", "d", "X"), ("q", "a", None)], "source string, target string, display_name string")
    got = sorted((r.profile, r.display_name, r.slug, r.segments, r.meetings) for r in upkeep.fold_profiles(p, m).collect())
    assert got == [("a", "A", "sb", 3, ["m1", "m2"]), ("d", "D", "sd", 8, ["m3"]), ("z", "C", None, 4, [])]


def test_chapters(spark):
    text = "Agenda\n 0:00 Intro\r\n1:02:03\tSecond item  \n75:00 Third\n12:00\nat 13:00 no"
    d = spark.createDataFrame([(1, text), (2, "1:00 alone"), (3, None), (4, "")], "k int, t string")
    got = sorted(tuple(r) for r in upkeep.description_chapters(d, "k", "t").collect())
    assert got == [(1, 0, 0.0, 3723.0, "Intro"), (1, 1, 3723.0, 4500.0, "Second item"), (1, 2, 4500.0, None, "Third")]


def turn(text, start, gap=0.0):
    return [(w, start + 0.4 * i + (gap if i else 0.0), start + 0.4 * i + (gap if i else 0.0) + 0.4, start * 100 + i) for i, w in enumerate(text.split())]


def snapped(spark, *cases):
    """The turns of each case, a meeting, after words went back."""
    turns = [(m, t, 100.0 * t) for m, case in enumerate(cases) for t in range(len(case))]
    rows = [(m, t, 100 * t + i, *w[:3]) for m, case in enumerate(cases) for t, said in enumerate(case) for i, w in enumerate(said)]
    w = spark.createDataFrame(rows, "meeting int, turn_id int, word_id int, word string, word_start double, word_end double")
    told = {(r.meeting, r.word_id): r.turn_id for r in words.snap(w, spark.createDataFrame(turns, "meeting int, turn_id int, start_time double")).collect()}
    return [[" ".join(r[3] for r in sorted(rows, key=lambda r: r[4]) if r[0] == m and told[m, r[2]] == t) for t in range(len(case))] for m, case in enumerate(cases)]


def test_strayed_words_go_back(spark):
    got = snapped(
        spark,
        [turn("we shall go", 0), turn("on now. >> Thank you", 10)],
        [turn("we shall go", 0), turn("and so it goes on. >> Thanks all", 10)],
        [turn("that is all. >> Yes sir", 0), turn("I agree", 10)],
        [turn(">> one >> two >> three", 0), turn("four", 10)],
        [turn("the end is", 0), turn("near. Now to us", 1.25, 0.5)],
        [turn("the end is", 0), turn("Here. Now to us", 3.0, 0.5)],
        [turn("the end is", 0), turn("Yes.", 1.25)],
        [turn("a b. >> c", 0), [], turn("d e", 9)],
    )
    assert got[0] == ["we shall go on now.", ">> Thank you"]
    assert got[1][0] == "we shall go"
    assert got[2] == ["that is all.", ">> Yes sir I agree"]
    assert got[3] == [">> one >> two >> three", "four"]
    assert got[4] == ["the end is near.", "Now to us"]
    assert got[5][1] == "Here. Now to us"
    assert got[6] == ["the end is", "Yes."]
    assert got[7] == ["a b.", ">> c", "d e"]


def test_snapping_keeps_every_word(spark):
    """A second time nothing moves, and each word has one turn."""
    rnd = random.Random(3)
    rows, turns = [], []
    for m in range(6):
        for t in range(8):
            turns.append((m, t, t * 10.0))
            said = rnd.choices(["so", "yes.", ">>", "well", "go?"], k=rnd.randrange(7))
            rows += [(m, t, t * 100 + i, w, t * 10 + i * 0.4, t * 10 + i * 0.4 + 0.3) for i, w in enumerate(said)]
    schema = "meeting int, turn_id int, word_id int, word string, word_start double, word_end double"
    w, t = spark.createDataFrame(rows, schema), spark.createDataFrame(turns, "meeting int, turn_id int, start_time double")
    once = words.snap(w, t)
    got = {(r.meeting, r.word_id): r.turn_id for r in once.collect()}
    assert len(got) == len(rows) == once.count()
    again = words.snap(w.drop("turn_id").join(once, ["meeting", "word_id"]), t)
    assert {(r.meeting, r.word_id): r.turn_id for r in again.collect()} == got
    assert words.snap(w.limit(0), t.limit(0)).count() == 0

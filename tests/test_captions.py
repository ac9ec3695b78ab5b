"""Rolling captions: what is left of them, and whose turn it is said in."""

import random

from pyspark.sql import functions as F

from plenum.sources import captions as C

VTT = """WEBVTT
Kind: captions

00:00.000 --> 00:02.000 align:start
Good<00:00.500><c> evening</c>
evening &amp; welcome

00:00:02.000 --> 00:00:02.040
good evening & welcome

00:00:02.040 --> 00:00:04.040
& WELCOME, all of you

00:00:05.000 --> 00:00:06.000
No

00:00:06.000 --> 00:00:07.000
No

bad --> line
lost

00:00:08.000 --> 00:00:08.000
nothing
"""


def longest(said, new):
    return max(k for k in range(min(len(said), len(new)) + 1) if k == 0 or said[-k:] == new[:k])


def test_overlap_against_every_length():
    r = random.Random(2)
    for _ in range(3000):
        said, new = ([r.choice("ab") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert C.overlap(said, new) == longest(said, new)
    assert C.overlap(["a"] * 200_000, ["a"] * 100_000) == 100_000


def test_words_once(spark):
    docs = spark.createDataFrame([(1, VTT), (2, None), (3, "")], "meeting int, vtt string")
    cues = C.cues(docs, "meeting", "vtt")
    words = C.timed_words(cues, "meeting").orderBy("word_id").collect()
    assert [r.word for r in words] == ["Good", "evening", "&", "welcome", "all", "of", "you", "No", "No"]
    assert (words[1].word_start, words[1].word_end) == (0.5, 1.0) and words[4].word_start == 2.84
    assert [tuple(r) for r in C.caption_text(cues, "meeting").collect()] == [(1, "Good evening & welcome all of you No No")]
    turns = spark.createDataFrame([(1, 10, 0.0, 2.5), (1, 11, 2.5, 6.0), (1, 12, 9.0, 12.0)], "meeting int, segment_id int, start_time double, end_time double")
    got = {r.segment_id: r.text for r in C.align(cues, turns).collect()}
    assert got == {10: "Good evening & welcome", 11: "all of you No", 12: None}
    moved = {r.segment_id: r.text for r in C.align(cues, turns, offset=5.0).collect()}
    assert moved == {10: "No No", 11: None, 12: None}
    assert C.timed_words(cues.limit(0), "meeting").count() == 0

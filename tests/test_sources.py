"""Readers of captions, diarization files and feeds, and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from plenum.sources import captions, feeds, rttm
from plenum.streaming import polls


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n1\n00:01.500 --> 00:03.000\nhello <b>there</b>\n\nno time\n\n01:00:00,250 --> 01:00:02.000 align:start\nthere my friend\n")
    got = captions.read_vtt(spark, f"file://{tmp_path}").orderBy("cue").collect()
    assert [(r.cue, r.start, r.end, r.lines) for r in got] == [(0, 1.5, 3.0, ["hello there"]), (1, 3600.25, 3602.0, ["there my friend"])]
    d = spark.createDataFrame([(["a b c", "b c d", "d", "e f"],), ([],), (["a a", "a"],)], "l array<string>")
    assert [r[0] for r in d.select(captions.merge_rolling(F.col("l"))).collect()] == ["a b c d e f", "", "a a"]


def test_rttm(spark, tmp_path):
    (tmp_path / "x.rttm").write_text("SPEAKER m 1 0.500 2.250 <NA> <NA> S1 <NA> <NA>\n;; note\nSPEAKER m 1 bad\n")
    (tmp_path / "x.uem").write_text("# note\n\nm 1 0.0 10.0\n")
    (tmp_path / "bad.uem").write_text("m 1\n")
    r = rttm.read_rttm(spark, f"file://{tmp_path}/x.rttm").collect()
    assert [tuple(x) for x in r] == [("m", 0.5, 2.75, "S1")]
    line = rttm.read_rttm(spark, f"file://{tmp_path}/x.rttm").select(rttm.rttm_line("file")).first()[0]
    assert line == "SPEAKER m 1 0.500 2.250 <NA> <NA> S1 <NA> <NA>"
    assert [tuple(x) for x in rttm.read_uem(spark, f"file://{tmp_path}/x.uem").collect()] == [("m", 0.0, 10.0)]
    with pytest.raises(Exception, match="not a UEM line"):
        rttm.read_uem(spark, f"file://{tmp_path}/bad.uem").collect()


def test_feeds(spark):
    atom = '<feed xmlns:yt="y"><entry><yt:videoId>abcdefghijk</yt:videoId><title> A </title><published>2024-01-02</published></entry><entry><title>B</title><link rel="alternate" href="https://v/x"/></entry><entry><title>C</title></entry></feed>'
    got = feeds.video_feed(spark.createDataFrame([(1, atom)], "outlet_id int, xml string")).collect()
    assert [(r.url, r.title) for r in got] == [("https://www.youtube.com/watch?v=abcdefghijk", "A"), ("https://v/x", "B")]
    rss = '<rss><channel><title>t</title><item><title>A</title><link>https://a/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate></item><item><title>B</title><guid isPermaLink="false">zz</guid><enclosure url="https://a/2.mp3" type="audio/mpeg"/></item><item><title>C</title><link>ftp://x</link></item></channel></rss>'
    got = feeds.item_feed(spark.createDataFrame([(1, rss)], "outlet_id int, xml string")).collect()
    assert [(r.url, r.published_at) for r in got] == [("https://a/1", "2024-01-02T09:00:00Z"), ("https://a/2.mp3", None)]


def test_marker_changes(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = lambda xs: spark.createDataFrame(xs, "k string, m string, t long").coalesce(1)
    rows([("a", "1", 2), ("b", "1", 1), ("a", "0", 1)]).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, m string, t long").parquet(path)
    run = lambda: polls.marker_changes(stream.withColumn("t", F.timestamp_seconds("t")), "k", "m", "t").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    rows([("a", "1", 3), ("b", "2", 4)]).write.mode("append").parquet(path)
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", F.coalesce("old", F.lit("-")), "new").collect()))
    assert got == [("a", "-", "0"), ("a", "0", "1"), ("b", "-", "1"), ("b", "1", "2")]


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame(xs, "k string, v int, t int")
    path = str(tmp_path / "latest")
    polls.UpsertSink(path, ["k"], ["t"])(rows([("a", 1, 1), ("b", 1, 1)]), 0)
    again = polls.UpsertSink(path, ["k"], ["t"])  # another process: nothing in memory
    again(rows([("b", 2, 2), ("a", 0, 0)]), 1)
    again(rows([("b", 2, 2), ("a", 0, 0)]), 1)  # the same batch once more
    read = lambda: sorted(map(tuple, spark.read.parquet(again.newest(spark)).select("k", "v").collect()))
    assert read() == [("a", 1), ("b", 2)]
    again(rows([("c", 3, 3)]), 2)
    assert read() == [("a", 1), ("b", 2), ("c", 3)] and polls.UpsertSink(path + "x", ["k"], ["t"]).newest(spark) is None

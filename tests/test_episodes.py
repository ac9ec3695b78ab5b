"""Entries of feeds against a plain search, pages and lists by hand-made cases, stages against replaying the log one by one."""

import random
import uuid

from pyspark.sql import functions as F

from plenum.functions.graph import scratch_dir
from plenum.operators import episodes, stages
from plenum.sources import episodes as source

ENTRY = "show int, place int, link string, guid string, audio_url string, tier string"


def test_matches_equal_a_plain_search(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("ab1-") for _ in range(r.randrange(1, 9))).strip("-/") or "a"
    entries = [
        (r.randrange(3), i, r.choice([None, f"https://H.example.org/{word()}/?q=1"]), r.choice([None, "", word(), f"http://h.example.org/{word()}"]), r.choice([None, f"https://c.example.org/{word()}{word()}.mp3"]), "x")
        for i in range(150)
    ]
    pages = [(i, r.choice([0, 1, 2, 7]), r.choice([f"https://h.example.org/{word()}/", f"http://h.example.org/e/{word()}{word()}?a=b#c", f"{word()}"]), i) for i in range(200)]
    pages += [(900, None, "https://h.example.org/a", 0), (901, 0, None, 0), (902, 0, "  ", 0), (903, 0, "https://h.example.org/", 0), (904, 0, "https://h.example.org/12345", 0), (200, 1, pages[0][2], 0)]
    e = spark.createDataFrame(entries, ENTRY)
    p = spark.createDataFrame(pages, "page int, show int, address string, slug int")

    def key(x):
        x = (x or "").strip()
        if x.lower().startswith(("http://", "https://")):
            x = x.split("://", 1)[1].split("?")[0].split("#")[0]
            host, _, path = x.partition("/")
            x = f"{host.lower()}/{path}"
        return x.rstrip("/")

    def want(show, address):
        mine = [x for x in entries if x[0] == show and show is not None]
        full = key(address)
        for x in mine:
            if full and full in (key(x[2]), key(x[3])):
                return "link", x[1]
        path = (address or "").strip().split("?")[0].split("#")[0]
        parts = [s for s in (path.split("://", 1)[1].split("/")[1:] if "://" in path else path.split("/")) if s]
        if parts and not parts[-1].isdigit():
            for x in mine:
                if parts[-1].lower() in f"{x[4] or ''} {x[3] or ''} {x[2] or ''}".lower():
                    return "slug", x[1]
        return None, None

    got = {(x.page, x.show, x.address): (x.tier, x.place) for x in episodes.match_entries(p, e).collect()}
    assert len(got) == len(pages)
    assert got == {(x[0], x[1], x[2]): want(x[1], x[2]) for x in pages}
    assert {t for t, _ in got.values()} == {"link", "slug", None}
    assert episodes.match_entries(p.limit(0), e).collect() == [] and {x.tier for x in episodes.match_entries(p, e.limit(0)).collect()} == {None}


def test_pages(spark):
    ld = lambda j: f'<script data-x type="application/ld+json">{j}</script>'
    rows = [
        ld("[1, null]") + ld("oops") + ld('{"@type":["RadioEpisode"],"name":"First"}') + ld('{"@type":"PodcastEpisode","name":"Second"}') + "<meta property='og:image' content='a&amp;lt;b&#x41;&#0;&nope;&#233;'>",
        ld('{"@type":"NewsArticle","headline":"Head","datePublished":"2024-05-06"}') + '<meta content="before" property="og:description"><META property="og:description" content="after">',
        "",
        None,
        "<p>outside this article, long enough</p><article class=a><p>short</p><p class='x'>One  <b>two</b>&nbsp;three\nfour five six</p><p>Never closed but quite long enough<p>And here is the next one of them</article><p>outside, long enough to be kept</p>",
        "<body><p>A page without any article at all</p></body>",
    ]
    d = spark.createDataFrame([(i, x, "own") for i, x in enumerate(rows)], "id int, html string, told string")
    got = {x.id: x for x in source.page_meta(d).withColumn("said", source.spoken_paragraphs(F.col("html"))).collect()}
    assert got[0].meta.title == "First" and got[0].meta.image == "a&lt;bA&#0;&nope;é" and got[0].meta.date is None
    assert got[1].meta.asDict() == {"date": "2024-05-06", "title": "Head", "outlet": None, "image": None, "description": "after"}
    assert all(v is None for i in (2, 3) for v in got[i].meta) and got[2].said is None and got[3].said is None
    assert got[4].said.split("\n\n") == ["One two  three four five six", "Never closed but quite long enough", "And here is the next one of them"]
    assert got[5].said == "A page without any article at all"


def test_audio(spark):
    html = 'src="https://cdn.example.net/a/one.mp3?x" \'https://CDN.example.net/b/Budget-web.MP3\' https://else.example.org/budget.mp3'
    d = spark.createDataFrame([(html, "The budget of it"), (html, "the of"), (html, None), ("none", "budget"), (None, "x")], "html string, head string")
    got = [x[0] for x in d.select(source.episode_audio(F.col("html"), F.col("head"), "cdn.example.net")).collect()]
    assert got == ["https://CDN.example.net/b/Budget-web.MP3", *["https://cdn.example.net/a/one.mp3"] * 2, None, None]


def test_lists(spark):
    text = '{"granules":[{"granuleId":"a","docClass":"HOUSE"},{"granuleId":"b","granuleClass":"","docClass":"HOUSE","title":"T"},{"granuleId":"","granuleClass":"HOUSE"},{"granuleClass":"HOUSE"},{"granuleId":"c","granuleClass":"DIGEST","docClass":"HOUSE"},7]}'
    d = spark.createDataFrame([(1, text), (2, "nope"), (3, None), (4, "[]"), (5, '{"granules":{}}')], "day int, text string")
    assert [tuple(x) for x in source.record_parts(d, "House").orderBy("place").collect()] == [(1, 0, "a", "HOUSE", ""), (1, 1, "b", "HOUSE", "T")]


def test_feeds(spark):
    xml = """<rss><channel><title>T</title><item><title> A </title><guid isPermaLink="false">g-1</guid><enclosure url="http://x/p.jpg" type="image/jpeg"/><enclosure url="http://x/a.M4A"/>
      <pubDate>Tue, 02 Jan 2024 05:00:00 GMT</pubDate></item><item><link>http://x/2</link><enclosure url="http://x/only.bin" type="b"/><pubDate>soon</pubDate></item></channel></rss>"""
    d = spark.createDataFrame([(1, xml), (2, "<rss><channel></channel></rss>"), (3, None)], "show int, xml string")
    a, b = source.podcast_entries(d).orderBy("place").collect()
    assert (a.title, a.guid, a.audio_url, a.date, a.description, a.outlet) == ("A", "g-1", "http://x/a.M4A", "2024-01-02", "", "T")
    assert (b.title, b.link, b.audio_url, b.date, b.place) == (None, "http://x/2", "http://x/only.bin", None, 1)


def _replay(log):
    out = {}
    for meeting, _, action, value in sorted(log, key=lambda x: (str(x[0]), x[1])):
        s = out.setdefault(meeting, {"completed": 0, "progress": 0, "live": set()})
        if action == "done" and value is not None and 0 <= value <= 7:
            s["completed"] = value
            s["live"] |= {value} & set(stages.LEAVES)
        elif action == "progress" and value is not None:
            s["progress"] = value
        elif action == "retag":
            s["completed"] = 3
            s["live"] -= {4}
        elif action == "rewind":
            to = max(value if value is not None else 2, 2)
            s["completed"] = to - 1
            s["live"] = {x for x in s["live"] if x < to}
            if to <= 3:
                s["progress"] = 0
    return {m: (s["completed"], s["progress"], [stages.STAGES[x] for x in sorted(s["live"])], stages.STAGES[s["completed"] + 1 :]) for m, s in out.items()}


def test_stages(spark):
    r = random.Random(3)
    log = [(r.choice([1, 2, 3, None, *range(4, 30)]), i, r.choice(["done", "done", "progress", "rewind", "retag", "done", None, "else"]), r.choice([None, *range(9)])) for i in range(600)]
    schema = "meeting int, seq int, action string, value int"
    d = spark.createDataFrame(log, schema)
    want = _replay(log)
    read = lambda df: {x.meeting: (x.completed, x.progress, x.live, x.open) for x in df.collect()}
    assert read(stages.stage_states(d)) == want
    assert stages.stage_states(d.limit(0)).collect() == []
    # the same plan as a stream, its rows in any order
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    d.repartition(5).write.parquet(path)
    name = f"stages_{uuid.uuid4().hex}"
    stream = stages.stage_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert read(spark.table(name)) == want


def test_polls(spark):
    listing = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, None, 0), (5, "", 0), (6, "a", 0)], "k int, marker string, known int")
    state = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None), (6, None)], "k int, marker string")
    facts = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    got = {x.k: x.action for x in stages.poll_plan(listing, state, facts, "k").collect()}
    assert got == {1: "skip", 2: "heal", 3: "run", 4: "wait", 5: "wait", 6: "run"}

"""Rule tables, anchors, spoken names, lookups and row decisions."""

from pyspark.sql import functions as F

from plenum.functions import rules
from plenum.operators import matching


def test_spoken_names(spark):
    rows = [(1, "Well, I'm Commissioner Ida Volk and I live here."), (2, "Chair recognizes council  member Bo Tran"), (3, "vice-mayor Lee ?"), (4, "As the auditor, clerk Uma Roe, I am Tom Poe"), (5, "Supervisor of nobody? Mayor Yes?"), (6, None)]
    got = matching.spoken_names(spark.createDataFrame(rows, "segment_id int, text string")).collect()
    assert sorted((r.segment_id, r.family, r.name) for r in got) == [
        (1, "self_identification", "Ida Volk"), (2, "chair_recognition", "Bo Tran"), (3, "roll_call", "Lee"), (4, "name_addressing", "Uma Roe"), (4, "title_context", "Auditor"),
    ]


def test_anchors_leave_shared_references_out(spark):
    items = spark.createDataFrame([(1, "R 1"), (2, "R 2"), (3, "R 2")], "item_id int, ref string")
    said = spark.createDataFrame([(10, "R 1 and R 1"), (7, "R 2, R 1"), (8, None)], "segment_id int, text string")
    assert [tuple(r) for r in matching.anchors(items, said, r"R \d+").collect()] == [(1, [7, 10])]


def test_lookup_and_rules(spark):
    e = spark.createDataFrame([(2, "b", "s", "second"), (1, "b", "7", "first"), (3, "c", "s", "third")], "position int, link string, slug string, value string")
    a = spark.createDataFrame([(1, "b", "x"), (2, "z", "s"), (3, "z", "7"), (4, None, None)], "ask_id int, link string, slug string")
    assert sorted(map(tuple, matching.tiered_lookup(a, e).collect()), key=lambda r: r[0]) == [(1, "first", 1), (2, "second", 2), (3, None, None), (4, None, None)]
    r = spark.createDataFrame([(2, "an", "B"), (1, "BAN", "A")], "ordinal int, keyword string, value string")
    rows = spark.createDataFrame([(1, "Banana"), (2, "man"), (3, None)], "k int, t string")
    assert {x.k: x.value for x in matching.first_rule(rows, r, "k", "t").collect()} == {1: "A", 2: "B", 3: None}


def test_row_decisions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(rules.identity_key(F.lit(" "), F.lit(None).cast("string"), F.lit("Dr. Jane Adams"))) == "name:jane adams"
    assert one(rules.identity_key(F.lit("a"), F.lit("b"), F.lit("c"))) == "essentials:a"
    assert [one(rules.speaker_label(F.lit(x))) for x in ("Speaker 7", "spk_123", " mr. chair")] == ["SPEAKER_07", "SPEAKER_123", "MR_CHAIR"]
    assert one(rules.distinct_ignoring_case(F.array(*map(F.lit, ["A", "b", "a", "B", "c"])))) == ["A", "b", "c"]
    assert one(rules.ungrounded(F.lit("8-0 on 2026-13, 5 of 9"), F.lit("9 said 8-0"))) == ["2026-13", "5"]
    assert one(rules.event_name_slug(F.lit("Dr. Jane Mary Adams"))) == "adams_jane_mary" and one(rules.event_name_slug(F.lit("Cher"))) == "cher"
    assert [one(rules.first_and_more(F.array(*map(F.lit, x)))) for x in (["a"], ["a", "b", "c", "d", "e"])] == ["a", "a, b, c +2 more"]

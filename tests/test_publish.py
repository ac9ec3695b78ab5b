"""Publications by hand: refusals, replaced parts, lists put in place whole, and a loss between two tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from plenum.functions.graph import scratch_dir
from plenum.operators import publish as P


def board(spark):
    return P.Board(spark, f"{scratch_dir(spark)}/board-{uuid.uuid4().hex}")


def test_tables_are_shown_together(spark):
    b = board(spark)
    assert b.tables() == {}
    one, two = spark.range(3), spark.range(5).select(F.col("id").alias("x"))
    assert b.put("first", {"a": one, "b": two}) and not b.put("first", {"a": two})
    assert {n: t.count() for n, t in b.tables().items()} == {"a": 3, "b": 5}
    # the second of two tables is lost: nothing of the publication is seen, and it may run again
    broken = two.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        b.put("second", {"a": one.union(one), "b": broken})
    assert {n: t.count() for n, t in b.tables().items()} == {"a": 3, "b": 5}
    assert b.put("second", {"a": one.union(one)}) and {n: t.count() for n, t in b.tables().items()} == {"a": 6, "b": 5}
    assert b.put("third", {"c": one.limit(0)}) and b.tables()["c"].collect() == [] and not b.put("first", {})


def test_another_publication_comes_first(spark):
    b = board(spark)
    b.put("first", {"a": spark.range(1)})
    seen = b._lists()
    b.put("second", {"a": spark.range(2)})
    late = P.Board(spark, b.path)
    late._lists = lambda: seen
    with pytest.raises(Exception, match="[Ee]xist"):
        late.put("third", {"a": spark.range(9)})
    assert b.tables()["a"].count() == 2


def test_publish(spark):
    people = spark.createDataFrame([(1, "a", " Ann"), (1, "b", "ann "), (2, "a", ""), (2, "b", None), (2, "c", " "), (3, "a", "Bo"), (3, "b", "Bo"), (None, "a", "x")], "meeting int, label string, name string")
    hidden = (F.col("meeting") == 3) & (F.col("label") == "b")
    assert [tuple(x) for x in P.refused(people, hidden).collect()] == [(1, "ann", 2)]
    stored = {
        "meetings": spark.createDataFrame([(1, "old", 7, 7), (2, "old", 7, 7), (9, "old", 7, 7)], "meeting int, title string, n_segments long, n_speakers long"),
        "segments": spark.createDataFrame([(1, "s1"), (2, "s2"), (9, "s9"), (None, "s0")], "meeting int, text string"),
        "speakers": people.limit(0).unionByName(spark.createDataFrame([(2, "z", "gone")], people.schema)),
    }
    meetings = spark.createDataFrame([(1, "new"), (2, "new"), (3, "new")], "meeting int, title string")
    segments = spark.createDataFrame([(1, "n"), (3, "n"), (3, "n"), (8, "n")], "meeting int, text string")
    read = lambda t: sorted((str(tuple(x)) for x in t.collect()))
    once = P.publish(stored, meetings, segments, people, hidden)
    assert read(once["meetings"]) == ["(1, 'old', 7, 7)", "(2, 'new', 0, 3)", "(3, 'new', 2, 2)", "(9, 'old', 7, 7)"]
    assert read(once["segments"]) == ["(1, 's1')", "(3, 'n')", "(3, 'n')", "(9, 's9')", "(None, 's0')"]
    assert len(read(once["speakers"])) == 5
    again = P.publish(once, meetings, segments, people, hidden)
    assert all(read(again[n]) == read(once[n]) for n in once)


def test_items(spark):
    spans = spark.createDataFrame([(1, 0, 0, 1, "passed"), (1, 1, None, 1, None), (1, 2, 5, 5, "failed"), (2, 0, 0, 0, None)], "meeting int, position int, first int, last int, outcome string")
    segments = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 9.0), (2, 0, 4.0, 5.0)], "meeting int, place int, start_time double, end_time double")
    items = spark.createDataFrame([(1, 0, "upcoming", None, None, "tabled", "x"), (1, 1, "upcoming", 3.0, 4.0, "kept", "x"), (1, 2, None, None, None, None, "x"), (1, 3, "upcoming", 1.0, 2.0, None, "x")], "meeting int, position int, status string, start double, end double, outcome string, __start string")
    got = {x.position: tuple(x)[2:6] for x in P.flip_items(items, P.alignment_updates(spans, segments)).collect()}
    assert got == {0: ("happened", 0.0, 9.0, "tabled"), 1: ("happened", None, None, "kept"), 2: ("happened", None, None, "failed"), 3: ("upcoming", 1.0, 2.0, None)}

"""Agendas and roll calls."""

from pyspark.sql import functions as F

from plenum.sources import minutes

AGENDA = """Harbour Board
1. Welcome
2. Old business (as far as
the tide allows)
A. Dredging
B. Moorings, buoys,
and lamps
7. New business
A. Appropriation  Ordinance 2031-4 — Paying for the north
quay wall
Council Sponsor - n/a
3https://harbour.example/live
Code 77
B. Resolution 2031-21: fees of the ferry
Council Sponsors: CM Okafor
Held over
12. Close
Doors shut at nine
https://harbour.example/
"""


def test_agenda(spark):
    d = spark.createDataFrame([(1, AGENDA), (2, ""), (3, None), (4, "A. adrift\n\n")], "doc int, text string")
    got = minutes.agenda_items(d).orderBy("position").collect()
    assert [(r.doc, r.position, r.item_number, r.title_raw, r.legislation_ref, r.sponsor, r.extra_lines) for r in got] == [
        (1, 1, "1", "Welcome", None, None, []),
        (1, 2, "2A", "Dredging", None, None, []),
        (1, 3, "2B", "Moorings, buoys, and lamps", None, None, []),
        (1, 4, "7A", "Appropriation  Ordinance 2031-4 — Paying for the north quay wall", "Appropriation Ordinance 2031-4", None, []),
        (1, 5, "7B", "Resolution 2031-21: fees of the ferry", "Resolution 2031-21", "CM Okafor", ["Held over"]),
        (1, 6, "12", "Close", None, None, []),
    ]
    assert got[1].section == "Old business (as far as the tide allows)"


def test_lines_that_only_look_like_others(spark):
    lines = ["100. too far", "AB. two letters", "3.no space", "a. small", "Council Sponsor", "see http://x.example", "4 http://x.example", "9. Nine", "Z. Last"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    assert [r.k for r in d.orderBy("i").select(minutes.kind(F.col("line")).alias("k")).collect()] == ["other"] * 6 + ["footnote", "section", "item"]
    refs = ["On Ordinance 2031-4x", "Ordinance of 1999", "Resolution 31-4", "(Resolution 2031-9)", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(refs)], "i int, t string")
    assert [r.r for r in t.orderBy("i").select(minutes.legislation_ref(F.col("t")).alias("r")).collect()] == ["Ordinance 2031-4", None, None, "Resolution 2031-9", None]


def test_rolls(spark):
    text = "talk\n [Roll No. 12]\n  YEAS--2\n\n     Tamm\n[[Page H7]]\n     Del Rio, Ana M.\n  NAYS--1\n  Quist\n ANSWERED ``PRESENT''--1\n Ozols\n NOT VOTING--1\n Vance (OH)\n{time} 0900\n Ms. TAMM changed her vote\n So the treaty was\nnot adopted.\n"
    d = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc int, text string")
    got = minutes.roll_calls(d).orderBy("position", "place").collect()
    assert [(r.roll_number, r.position, r.surname) for r in got] == [(12, "NAY", "Quist"), (12, "NOT_VOTING", "Vance (OH)"), (12, "PRESENT", "Ozols"), (12, "YEA", "Tamm"), (12, "YEA", "Del Rio, Ana M.")]
    o = [r.o for r in d.select(minutes.outcome(F.col("text")).alias("o")).collect()]
    assert (o[0].phrase, o[0].passed) == ("Not adopted", False) and o[1:] == [None, None]
    more = spark.createDataFrame([("So the wait was over and the levy was confirmed. A recount was ordered.",), ("The appeal was lost.",), ("So it was. The veto was sustained.",)], "t string")
    assert [(r.o.phrase, r.o.passed) for r in more.select(minutes.outcome(F.col("t")).alias("o")).collect()] == [("Confirmed", True), ("Lost", False), ("Sustained", True)]

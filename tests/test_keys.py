"""Keys of recordings, and names that differ in case."""

from pyspark.sql import functions as F

from plenum.functions import rules, text
from plenum.operators import identity


def test_source_keys(spark):
    told = {
        "https://A.example/x/?a=1&a-b=2": "url:a.example/x?a=1&a-b=2",
        "https://a.example/x?q=a+b": "url:a.example/x?q=a+b",
        "https://a.example/x?q=a%20b&utm_source=z&e=": "url:a.example/x?q=a+b",
        "https://a.example/x?b=2&a=~1&a=%2F": "url:a.example/x?a=%2F&a=~1&b=2",
        "https://a.example/x?q=%zz": "url:a.example/x?q=%25zz",
        "": "",
    }
    rows = spark.createDataFrame([(x,) for x in told], "u string")
    assert {r.u: r.k for r in rows.select("u", text.source_key(F.col("u")).alias("k")).collect()} == told


def test_first_of_each_case(spark):
    rows = spark.createDataFrame([(1, ["b", "A", "B", "a", "C"]), (2, []), (3, None)], "k int, l array<string>")
    assert {r.k: r.o for r in rows.select("k", rules.distinct_ignoring_case(F.col("l")).alias("o")).collect()} == {1: ["b", "A", "C"], 2: [], 3: None}


def test_unique_by_counts(spark):
    known = spark.createDataFrame([("s", "NY", 1), ("s", "CA", 2), ("s", "CA", 3), ("t", None, 4), ("t", "NY", None)], "k string, state string, member int")
    asked = spark.createDataFrame([(1, "s", "NY"), (2, "s", "CA"), (3, "s", None), (4, "t", None), (5, "t", "NY"), (6, "u", "NY")], "ask_id int, k string, state string")
    got = {r.ask_id: (r.status, r.member, r.choices) for r in identity.resolve_unique(asked, known, ["k"], "state", "member").collect()}
    assert got == {1: ("resolved", 1, 1), 2: ("ambiguous", None, 2), 3: ("ambiguous", None, 3), 4: ("resolved", 4, 1), 5: ("unknown", None, 0), 6: ("unknown", None, 0)}

"""Names that are alike, against the standard library's measure over all pairs, and corrections by a roster."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import similar


def words(seed, n, letters="abcdeé"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(n)]


def score(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_measure(spark):
    pairs = [(a, b) for a, b in zip(words(1, 300, "abcX"), words(2, 300, "abcx"), strict=True)] + [("", ""), ("a", ""), (None, None), ("Smithey", "Smith"), ("aaaa", "aaa")]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", similar.alike(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r.i: round(r.s, 9) for r in got} == {i: round(score(a or "", b or ""), 9) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize("least", [0.8, 0.6, 1.0])
def test_join_against_all_pairs(spark, least):
    a, b = words(3, 150), words(4, 150)
    x = spark.createDataFrame([(w,) for w in [*a, *a[:9], None, ""]], "a string")
    y = spark.createDataFrame([(w,) for w in [*b, a[0], None, ""]], "b string")
    got = {(r.a, r.b) for r in similar.similar_names(x, y, "a", "b", least).collect()}
    assert got == {(p, q) for p in a for q in [*b, a[0]] if score(p, q) >= least}


def test_corrections(spark):
    roster = spark.createDataFrame([(1, "Jane Doe", ["Doe", "Jane Q Doe"]), (2, "Kim Piedmont-Smith", ["Piedmont-Smith", "Smith"]), (3, "Bo Lee", ["Lee", "van lee"])], "ordinal int, canonical string, aliases array<string>")
    said = {" jane doe ": ("Jane Doe", 1), "SMITH": ("Kim Piedmont-Smith", 2), "Council Member Lee": ("Bo Lee", 3), "Mary-Jane Q Doerr": ("Jane Doe", 3), "Mr. Smithe": ("Kim Piedmont-Smith", 4), "Nobody": ("Nobody", None), None: (None, None)}
    names = spark.createDataFrame([(x,) for x in [*said, "SMITH"]], "name string")
    got = {r.name: (r.corrected, r.tier) for r in similar.correct_names(names, roster).collect()}
    assert got == said
    assert {r.name: r.tier for r in similar.correct_names(names, roster, fuzzy=False).collect()}["Mr. Smithe"] is None
    assert similar.correct_names(names, roster.limit(0)).where("tier is not null").count() == 0
    on = {r.name: r.on_roster for r in similar.surnames_on_roster(names, roster, 0.75).collect()}
    assert on["Mr. Smithe"] and on["Council Member Lee"] and not on["Nobody"] and not on[None]

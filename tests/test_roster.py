"""Aliases by hand-made cases and a plain loop, chains of moves against following them one by one."""

import random

from pyspark.sql import functions as F

from plenum.operators import roster


def test_aliases(spark):
    people = [
        (1, "José Peña-Ruiz", "Pepe", "Council  President"), (2, " Cher ", None, "City Clerk"), (3, None, "x", "Mayor"), (4, "", "x", None),
        (5, "Ann Lee", "Ann", "Deputy Mayor Pro Tem"), (6, "李 李", None, None), (7, "ann LEE", "", "Vice President"), (7, "ann LEE", "", "Vice President"),
    ]
    d = spark.createDataFrame([(*p, 0) for p in people], "person int, full_name string, preferred_name string, title string, alias int")
    got = {}
    for r in d.distinct().select("person", roster.aliases(F.col("full_name"), F.col("preferred_name"), F.col("title")).alias("a")).collect():
        got[r.person] = r.a
    assert got[1][:4] == ["José Peña-Ruiz", "José Peña Ruiz", "Jose Pena-Ruiz", "Jose Pena Ruiz"]
    assert "Pepe Peña-Ruiz" in got[1] and got[1][-4:] == [f"President {x}" for x in ("Peña-Ruiz", "Peña Ruiz", "Pena-Ruiz", "Pena Ruiz")]
    assert got[2] == ["Cher", "City Clerk Cher"] and got[3] == got[4] == []
    assert got[5] == ["Ann Lee", "Lee", "Deputy Mayor Pro Tem Lee", "Mayor Pro Tem Lee"]
    assert got[6] == ["李 李", " ", "李"]  # a letter without an ASCII form leaves the space between
    index = roster.alias_index(d).collect()
    assert {r.holders for r in index if r.alias.lower() == "ann lee"} == {2} and len([r for r in index if r.person == 7 and r.place == 1]) == 2
    assert roster.alias_index(d.limit(0)).collect() == []


def test_moves_are_followed(spark):
    r = random.Random(5)
    moves = [(r.randrange(60), r.randrange(90), f"n{i}") for i in range(55)] + [(i, i + 1, f"c{i}") for i in range(100, 140)] + [(200, 201, None), (201, 200, "a"), (None, 1, "b"), (2, None, "c"), (3, 3, "d")]
    d = spark.createDataFrame(moves, "source long, target long, display_name string")
    best = {}
    for s, t, n in moves:
        if s is not None and t is not None and s != t:
            best[s] = min(best.get(s, (t, n)), (t, n), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    want = set()
    for s in best:
        at, name, seen = s, None, set()
        while at in best and at not in seen:
            seen.add(at)
            at, name = best[at]
        if at not in best:
            want.add((s, at, name))
    assert {tuple(x) for x in roster.settle_moves(d).collect()} == want and (100, 140, "c139") in want
    assert roster.settle_moves(d.limit(0)).collect() == []

"""Minutes with motions: hand-made minutes, and random ones against a plain reading of the rules."""

import random

from plenum.operators import reconcile as R
from plenum.sources import motions as M

MINUTES = """Meeting of July 1
1. Opening [6:30pm]
Ann moved, and Bo seconded that the agenda be approved. The motion received a roll call vote of Ayes: 9, Nays: 0, Abstain: 0.
7. Legislation for Second Reading [7:01 pm]
7.1. Ordinance 2026-13
Flaherty moved, and Zulich seconded that Ordinance 2026-13 be read by title and synopsis. The motion received
a roll call vote of Ayes: 9, Nays: 0, Abstain: 0.
Rollo moved, and De Ruff seconded that Ordinance 2026-13 be adopted.
Daily moved, and Rosenbarger seconded to adopt Amendment 01 to Ordinance 2026-13. The motion to adopt Amendment 01 received a roll call vote
of Ayes: 5 (A, B, C, D, E), Nays: 4 (F, G, H), Abstain: 0 (Rosenbarger, Ruff out of the room).
The motion to adopt Ordinance 2026-13 as amended received a roll call vote of Ayes: 2, Nays: 7, Abstain: 0. FAILED
7.2. Appropriation  Ordinance 2026-14 on money
Flaherty moved, and Zulich seconded that it be postponed until the next session to be held on July 29, 2026. The motion received a roll call vote of Ayes: 8, Nays: 1 (Ruff), Abstain: 0. PASSED
7.3. Report of the mayor
Flaherty moved, and Zulich seconded that it be adopted. The motion received a roll call vote of Ayes: 8, Nays: 1, Abstain: 0.
7.4. Resolution 2026-15
There was a roll call vote of sorts.
8. Adjournment
Memorandum prepared by the clerk
9.1. Resolution 2026-99
"""


def test_minutes(spark):
    docs = spark.createDataFrame([(1, MINUTES), (2, None), (3, "")], "doc int, text string")
    got = [r.asDict() for r in M.motions(docs).orderBy("position", "motion").collect()]
    assert [(r["legislation_ref"], r["motion"], r["mover"], r["seconder"], r["kind"], r["ayes"], r["nays"], r["tag"], r["carried"]) for r in got] == [
        ("Ordinance 2026-13", 1, "Flaherty", "Zulich", "procedural", 9, 0, None, True),
        ("Ordinance 2026-13", 2, "Rollo", "De Ruff", "adopt", 2, 7, "FAILED", False),
        ("Ordinance 2026-13", 3, "Daily", "Rosenbarger", "amend", 5, 4, None, True),
        ("Appropriation Ordinance 2026-14", 1, "Flaherty", "Zulich", "continue", 8, 1, "PASSED", True),
    ]
    assert got[2]["ayes_names"] == ["A", "B", "C", "D", "E"] and got[2]["nays_names"] == [] and got[2]["abstain_names"] == []
    assert got[3]["nays_names"] == ["Ruff"] and got[3]["continued_to"] == "2026-07-29" and got[0]["continued_to"] is None
    ends = [tuple(r)[1:] for r in M.dispositions(docs).orderBy("position").collect()]
    assert ends == [
        (1, "7.1", "Ordinance 2026-13", "7:01pm", 3, "failed", 2, 0, 0),
        (2, "7.2", "Appropriation Ordinance 2026-14", "7:01pm", 1, "continued", 1, 0, 0),
        (3, "7.4", "Resolution 2026-15", "7:01pm", 0, None, None, 0, 1),
    ]


def settle(kinds, results):
    """The rules of who takes a result, plainly: results are (owner, kind or None)."""
    taken, out = set(), []
    for owner, kind in results:
        free = [i for i in range(len(kinds)) if i not in taken]
        at = None
        if kind is None:
            at = owner if owner in free else None
        elif kind == kinds[owner] and owner in free:
            at = owner
        elif kind == "amend":
            ours = [i for i in free if kinds[i] == "amend"]
            at = ours[0] if len(ours) == 1 else None
        elif kind == "adopt":
            ours = [i for i in free if kinds[i] == "adopt"]
            at = ours[-1] if ours else None
        if at is not None:
            taken.add(at)
        out.append(at)
    return out


def test_results_against_plain_rules(spark):
    r = random.Random(6)
    say = {"adopt": "that it be adopted", "amend": "to adopt Amendment 01", "continue": "that it be tabled", "pull": "that it be withdrawn", "procedural": "that it be read by title"}
    tell = {"adopt": " to adopt it as amended", "amend": " to adopt Amendment 01", "continue": " to postpone it", "pull": " to withdraw it", "procedural": " to introduce it", None: ""}
    rows, want = [], {}
    for doc in range(150):
        kinds = [r.choice(list(say)) for _ in range(r.randint(0, 6))]
        lines, results = ["1.1. Resolution 2026-1"], []
        for i, kind in enumerate(kinds):
            lines.append(f"Ann moved, and Bo seconded {say[kind]}.")
            for _ in range(r.randint(0, 2)):
                results.append((i, r.choice(list(tell))))
                lines.append(f"The motion{tell[results[-1][1]]} received a roll call vote of Ayes: {len(results)}, Nays: 0, Abstain: 0.")
        rows.append((doc, "\n".join(lines)))
        by = settle(kinds, results)
        for i, kind in enumerate(kinds):
            want[doc, i + 1] = (kind, by.index(i) + 1 if i in by else None)
    got = {(x["doc"], x["motion"]): (x["kind"], x["ayes"]) for x in M.motions(spark.createDataFrame(rows, "doc int, text string")).collect()}
    assert got == want


def test_reconciliation(spark):
    """Acts by reference, by number, shared or missing; speakers by the ends of their names; results, outcomes and drift."""
    docs = spark.createDataFrame([(1, MINUTES)], "doc int, text string")
    agenda = spark.createDataFrame(
        [(1, 10, "Ordinance 2026-13", "passed"), (1, 11, "Resolution 2026-14", None), (1, 12, "Resolution 2026-15", None), (1, 13, "Resolution 2026-15", None), (1, 14, None, None), (2, 15, "Ordinance 2026-13", None)],
        "doc int, item_id int, legislation_ref string, outcome string",
    )
    ended, motions = M.dispositions(docs), M.motions(docs)
    matched = R.match_items(ended, agenda, "doc")
    assert [(r.legislation_ref, r.item_id, r.matched_by) for r in matched.orderBy("position").collect()] == [("Ordinance 2026-13", 10, "exact"), ("Appropriation Ordinance 2026-14", 11, "number"), ("Resolution 2026-15", None, "duplicate")]
    others = spark.createDataFrame([(1, 1, "Resolution 2026-13"), (1, 2, "Resolution 2026-14"), (1, 3, "Ordinance 2026-14"), (1, 4, "Resolution 2026-99"), (1, 5, "Ordinance 2026-15")], "doc int, position int, legislation_ref string")
    assert [r.matched_by for r in R.match_items(others, agenda, "doc").orderBy("position").collect()] == ["number", "exact", "ambiguous", "none", "ambiguous"]
    assert sorted(map(tuple, R.outcome_updates(ended, matched, agenda, "doc").collect())) == [(1, 10, "failed", "passed"), (1, 11, "continued", None)]
    speakers = spark.createDataFrame([(1, 1, "Ann A"), (1, 2, "b"), (1, 3, "Cy C"), (1, 4, "Di C"), (1, 5, "XD"), (1, 6, None), (1, 7, "Jo Ruff"), (2, 8, "E")], "doc int, speaker_id int, display_name string")
    votes = R.planned_votes(motions, matched, speakers, "doc").orderBy("position", "motion").collect()
    assert [(v.position, v.motion, v.result, v.item_id, [tuple(r) for r in v.records], v.skipped) for v in votes] == [
        (1, 2, "Failed 2–7", 10, [], 0), (1, 3, "Passed 5–4", 10, [(1, "aye"), (2, "aye")], 3), (2, 1, "Continued 8–1", 11, [(7, "nay")], 0),
    ]
    planned = spark.createDataFrame([("r", 1), ("r", 1), ("s", 2)], "resolution string, result int")
    stored = spark.createDataFrame([("r", 1), ("s", 2), ("t", 3)], "resolution string, result int")
    assert sorted(map(tuple, R.vote_drift(planned, stored, ["resolution", "result"]).collect())) == [("r", 1, 1), ("t", 3, -1)]

"""Turns of a printed record, and whom they name."""

from plenum.sources import record


def test_turns(spark):
    text = "[Page S1]\n\n        A TITLE\n\n  Mr. O'NEIL. I rise\nto speak.\n____________\n  The bill passed\r\nat last.\n\n          HEADING IN CAPITALS\n  The Trump Tower. No turn.\n  The Acting PRESIDENT pro tempore. Order. \n"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert [tuple(r) for r in record.turns(d, "k", "t").orderBy("position").collect()] == [
        (1, 0, "Mr. O'NEIL", "I rise to speak. The bill passed at last. The Trump Tower. No turn."), (1, 1, "The Acting PRESIDENT pro tempore", "Order."),
    ]
    assert record.turns(d.limit(0), "k", "t").count() == 0


def test_designations(spark):
    roster = spark.createDataFrame([("a", "Scott", "FL"), ("b", "Scott", "SC"), ("c", "Van Hollen", "MD"), ("d", None, "MD")], "member string, surname string, state string")
    said = ["Mr. SCOTT of Florida", "Mr. SCOTT", "Mr. Van HOLLEN", "The PRESIDING OFFICER (Mr. Scott)", "The PRESIDING OFFICER (Ms. Van Hollen)", "The presiding officer (Mr. Doe)", "The CHIEF JUSTICE", "Mr. Scott of Ohio", "nobody", None]
    got = {r.designation: (r.member, r.role, r.method, r.needs_review) for r in record.resolve(spark.createDataFrame([(x,) for x in said], "designation string"), roster).collect()}
    assert got == {
        said[0]: ("a", None, "surname_state", False), said[1]: (None, None, "ambiguous", True), said[2]: ("c", None, "surname", False),
        said[3]: (None, "presiding_officer", "ambiguous", True), said[4]: ("c", None, "presiding_parenthetical", False), said[5]: (None, "presiding_officer", "role", False),
        said[6]: (None, "chief_justice", "role", False), said[7]: (None, None, "ambiguous", True), said[8]: (None, None, "unresolved", False), None: (None, None, "unresolved", False),
    }

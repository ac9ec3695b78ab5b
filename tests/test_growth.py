"""Plans that must hold on larger tables, and results of steps that were rewritten for them."""

import re

from pyspark.sql import functions as F

from plenum.operators import episodes
from plenum.sources import minutes, motions


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_grams_of_addresses_are_not_broadcast(spark):
    e = spark.range(2000).select(F.floor(F.col("id") / 10).alias("show"), (F.col("id") % 10).cast("int").alias("place"), F.concat(F.lit("https://cdn.example.net/"), F.md5(F.col("id").cast("string")), F.lit(".mp3")).alias("audio_url"))
    e = e.withColumns({"link": F.lit(None).cast("string"), "guid": F.lit(None).cast("string")})
    p = e.select("show", "place", F.concat(F.lit("https://example.org/"), F.substring_index(F.substring_index("audio_url", "/", -1), ".", 1)).alias("address")).withColumnRenamed("place", "own")
    got = episodes.match_entries(p, e)
    assert got.where("tier = 'slug' and place = own").count() == 2000
    assert not re.search(r"BroadcastHashJoin \[show#\d+L?, gram#", final_plan(got))


def test_minutes_are_cut_into_items_without_rows_of_lines(spark):
    text = "1. Opening [6:30 pm]\r\n \t\r7. Bills [7:01 pm]\n  7.1.  Resolution \t 2026-1\x01\n\nAnn Lee moved, and  Bo seconded that it be\x02 adopted.\rThe  motion received a roll\ncall vote of Ayes: 2 (A, B), Nays: 0, Abstain: 0.\n7.2. Report\n7.3. Resolution 2026-2\n \n8. End\nMEMORANDUM prepared by me\n9.1. Resolution 2026-3"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "7.1. Ordinance 2026-7")], "doc int, text string")
    got = motions.items(docs)
    assert [tuple(r) for r in got.orderBy("doc", "position").collect()] == [
        (1, 1, "7.1", "Resolution 2026-1", "7:01pm", "Ann Lee moved, and Bo seconded that it be adopted. The motion received a roll call vote of Ayes: 2 (A, B), Nays: 0, Abstain: 0."),
        (1, 2, "7.3", "Resolution 2026-2", "7:01pm", ""),
        (4, 1, "7.1", "Ordinance 2026-7", None, ""),
    ]
    assert "Aggregate" not in final_plan(got)
    assert [(r.mover, r.seconder, r.kind, r.ayes, r.ayes_names, r.carried) for r in motions.motions(docs).collect()] == [("Ann Lee", "Bo", "adopt", 2, ["A", "B"], True)]


AGENDA = "A. Too early\n1. First (open\n  and )\tclosed here\nlost\n\nA.  Ordinance \t 2026-4 (x\n\thttps in (brackets\nCouncil Sponsors: CM One\n2 https://example.org\nwrapped\nCouncil Sponsor – CM Two \nextra\n  https://example.org/b\nB. Report\nhttp://x\nA lone line\n2. Alone\nCouncil Sponsors: n/a\nmore\r\n3. (Open\nCouncil sponsor: X)\nstill\n12. Last"


def test_agendas_are_read_without_rows_of_lines(spark):
    docs = spark.createDataFrame([(1, AGENDA), (2, None), (3, ""), (4, "B. none")], "doc int, text string")
    got = minutes.agenda_items(docs)
    assert [tuple(r) for r in got.orderBy("doc", "position").collect()] == [
        (1, 1, "1A", "First (open and )\tclosed here", 1, "Ordinance \t 2026-4 (x \thttps in (brackets", "Ordinance 2026-4", "CM Two", ["extra"]),
        (1, 2, "1B", "First (open and )\tclosed here", 1, "Report", None, None, []),
        (1, 3, "2", "Alone", 2, "Alone", None, None, []),
        (1, 4, "3", "(Open", 3, "(Open", None, None, []),
        (1, 5, "12", "Last", 12, "Last", None, None, []),
    ]
    assert "Aggregate" not in final_plan(got)


def test_roll_calls_are_read_without_sorts(spark):
    text = "before\nAYES--9\nNobody\n[Roll No. 7]\nTitle Case\n AYES--2\n Ann Lee \nBo\nnot a name\n NOES--1\nCy\nODD--1\nDi\nYEAS--1\nEd\n[Roll No x]\nAYES--1\nFay\n[Roll No. 8] \nANSWERED PRESENT--1\nGil\nNOT VOTING--1\nHa"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    got = minutes.roll_calls(docs)
    assert {tuple(r) for r in got.collect()} == {
        (1, 7, "YEA", 1, "Ann Lee"), (1, 7, "YEA", 2, "Bo"), (1, 7, "YEA", 3, "Ed"), (1, 7, "NAY", 1, "Cy"), (1, 8, "PRESENT", 1, "Gil"), (1, 8, "NOT_VOTING", 1, "Ha"),
    }
    assert "Sort" not in final_plan(got)

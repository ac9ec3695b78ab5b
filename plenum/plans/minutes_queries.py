"""Agendas and roll calls that are written out from the tables, and read back; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.sources import minutes

QUERIES, ORACLES, query = registry()
_ROWS = "select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem"


def _rows(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return V.table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w))


@query(f"""with r as ({_ROWS}) select l_orderkey, k as position, ((k - 1) // 26 + 1)::varchar || chr(65 + ((k - 1) % 26)::integer) as item_number, case when l_partkey % 3 > 0 then 'Ordinance 2026-' || l_partkey::varchar end as legislation_ref,
case when l_returnflag = 'R' then 'CM ' || l_suppkey::varchar end as sponsor, case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end::bigint as n_extra from r""")
def agenda_parse(spark, sf_dir):
    """Each order's lines as an agenda, a section for each 26 of them."""
    r = _rows(spark, sf_dir)
    k = F.col("k") - 1
    lines = F.concat_ws(
        "\n",
        F.when(k % 26 == 0, F.concat(F.floor(k / 26 + 1).cast("string"), F.lit(". Opening (long\nand open)"))),
        F.concat(F.char(k % 26 + 65), F.lit(". "), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("Ordinance 2026-"), F.col("l_partkey").cast("string"))).otherwise("Report"), F.lit(" – On a matter")),
        F.lit("that wraps"),
        F.when(F.col("l_linestatus") == "F", F.lit("1https://example.org/j\nwrapped note")),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Council Sponsor - CM "), F.col("l_suppkey").cast("string"))).otherwise("Council Sponsors: N/A"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.lit("Actions: none yet")),
    )
    text = r.groupBy("l_orderkey").agg(F.concat(F.lit("City\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", lines.alias("x")))), lambda s: s["x"]), "\n")).alias("text"))
    return minutes.agenda_items(text, "l_orderkey").select("l_orderkey", "position", "item_number", "legislation_ref", "sponsor", F.size("extra_lines").cast("long").alias("n_extra"))


@query("""select l_orderkey // 200 as doc, l_orderkey as roll_number, case l_returnflag when 'A' then 'YEA' when 'R' then 'NAY' else 'NOT_VOTING' end as position, count(*) as n from lineitem group by 1, 2, 3""")
def rollcall_parse(spark, sf_dir):
    """Each order's lines as a roll call, 200 order numbers a document."""
    li = V.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 200).alias("doc"), "l_orderkey", "l_returnflag", F.concat(F.lit("     Member"), F.translate(F.col("l_suppkey").cast("string"), "0123456789", "abcdefghij")).alias("name"))
    each = li.groupBy("doc", "l_orderkey", "l_returnflag").agg(F.array_join(F.collect_list("name"), "\n").alias("names"), F.count("*").cast("string").alias("c"))
    head = F.when(F.col("l_returnflag") == "A", "AYES--").when(F.col("l_returnflag") == "R", "NOES--").otherwise("NOT VOTING--")
    rolls = each.groupBy("doc", "l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("          "), head, F.col("c"), F.lit("\n\n"), F.col("names"), F.lit("\n[[Page H1]]\n"))), "\n").alias("body"))
    text = rolls.groupBy("doc").agg(F.array_join(F.collect_list(F.concat(F.lit("prose\n [Roll No. "), F.col("l_orderkey").cast("string"), F.lit("]\n"), F.col("body"), F.lit("{time}  1358\n  So the motion was agreed to.\n"))), "\n").alias("text"))
    return minutes.roll_calls(text, "doc").groupBy("doc", F.col("roll_number").cast("long").alias("roll_number"), "position").agg(F.count("*").alias("n"))

"""Turns of a printed record and whom their designations name; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.sources import record as R

QUERIES, ORACLES, query = registry()
T = V.table
_LETTERS = "translate({}::varchar, '0123456789', 'abcdefghij')"


def _name(x):
    return F.concat(F.lit("Q"), F.translate(x.cast("string"), "0123456789", "abcdefghij"))


def _designation(k, name):
    office = F.when(k == 2, F.concat(F.lit("The PRESIDING OFFICER (Mrs. "), name, F.lit(")"))).otherwise("The SPEAKER pro tempore")
    return F.when(k == 0, F.concat(F.lit("Mr. "), name)).when(k == 1, F.concat(F.lit("Ms. "), name, F.lit(" of New York"))).otherwise(office)


@query(f"""with c as (select c_nationkey, c_custkey, 'Q' || {_LETTERS.format('c_custkey')} as name from customer)
select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as position, case c_custkey % 4 when 0 then 'Mr. ' || name when 1 then 'Ms. ' || name || ' of New York'
when 2 then 'The PRESIDING OFFICER (Mrs. ' || name || ')' else 'The SPEAKER pro tempore' end as designation, 'I rise on ' || c_custkey::varchar || ' and yield. The clerk read on.' as text from c""")
def record_turns(spark, sf_dir):
    """Granules with headings, wrapped lines and page lines between the turns of a nation's customers."""
    k = F.col("c_custkey")
    turn = F.concat(
        F.lit("  "), _designation(k % 4, _name(k)), F.lit(". I rise on "), k.cast("string"), F.lit("\nand yield.\n[Page H1]\n\n          A HEADING\n\n  The clerk\nread on.\n"),
    )
    granules = T(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", turn.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return R.turns(granules.withColumn("text", F.concat(F.lit("The House met at noon.\n\n"), "text")), "c_nationkey", "text")


@query("""with r as (select s_suppkey as member, s_suppkey % 70 as sur, s_suppkey % 4 < 2 as ny from supplier), a as (select sur, count(*) as n, min(member) as m from r group by 1), h as (select sur, count(*) as n, min(member) as m from r where ny group by 1),
f as (select c_custkey, c_custkey % 4 as k, case when c_custkey % 4 = 1 then h.n end as here, case when c_custkey % 4 < 3 then coalesce(case when c_custkey % 4 = 1 then h.n end, a.n) end as n,
  coalesce(case when c_custkey % 4 = 1 then h.m end, a.m) as m from customer left join a on a.sur = c_custkey % 90 left join h on h.sur = c_custkey % 90)
select c_custkey, case when n = 1 then m end as member, case when coalesce(n, 0) <> 1 then case k when 2 then 'presiding_officer' when 3 then 'speaker' end end as role,
case when n = 1 then case when k = 2 then 'presiding_parenthetical' when here is not null then 'surname_state' else 'surname' end when n > 1 then 'ambiguous' when k >= 2 then 'role' else 'unresolved' end as method, coalesce(n > 1, false) as needs_review from f""")
def record_designations(spark, sf_dir):
    k = F.col("c_custkey")
    spoken = T(spark, sf_dir, "customer").select("c_custkey", _designation(k % 4, F.upper(_name(k % 90))).alias("designation"))
    s = F.col("s_suppkey")
    roster = T(spark, sf_dir, "supplier").select(s.alias("member"), _name(s % 70).alias("surname"), F.when(s % 4 < 2, "NY").otherwise("CA").alias("state"))
    return R.resolve(spoken, roster).drop("designation")

"""Aliases of people and chains of profile moves, over all customers; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import roster as R
from plenum.plans import views as V
from plenum.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query(r"""with p as (select c_custkey as person, ['José ', 'Ana María ', 'Zoë', 'Bob J. ', ' '][c_custkey % 5 + 1] || case when c_custkey % 5 = 4 then '' else ' Peña-Ruiz' || (c_custkey // 3)::varchar end as f,
  ['Pepe', null, 'Zoë', ''][c_custkey % 4 + 1] as c, ['Council President', 'City Clerk', 'Deputy Mayor', null, 'Vice Speaker Pro Tem', 'Vice  Chair', 'Mayor'][c_custkey % 7 + 1] as t from customer),
w as (select person, trim(f) as name, string_split_regex(trim(f), '\s+') as ws, coalesce(c, '') as c, coalesce(t, '') as t from p where trim(f) <> ''),
f as (select person, unnest([(1, name), (2, ws[-1]), (3, case when ws[1] <> ws[-1] then ws[1] || ' ' || ws[-1] end), (4, case when c <> '' and c <> ws[1] then c || ' ' || ws[-1] end),
  (5, case when t <> '' then t || ' ' || ws[-1] end),
  (6, case when regexp_full_match(t, '(Council|Vice|Deputy)\s+(President|Chair|Mayor|Speaker|Clerk)(\s.*)?') then regexp_replace(regexp_replace(t, '^\S+\s+', ''), '\s+', ' ', 'g') || ' ' || ws[-1] end)]) as x from w),
s as (select person, x[1] as form, unnest([(1, x[2]), (2, replace(x[2], '-', ' ')), (3, strip_accents(x[2])), (4, replace(strip_accents(x[2]), '-', ' '))]) as y from f where x[2] is not null),
o as (select person, y[2] as alias, form, y[1] as spelling from s qualify row_number() over (partition by person, lower(y[2]) order by form, y[1]) = 1),
n as (select person, (row_number() over (partition by person order by form, spelling))::int as place, alias from o)
select person, place, alias, count(*) over (partition by lower(alias)) as holders from n""")
def roster_aliases(spark, sf_dir):
    k = F.col("c_custkey").cast("int")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), k % n)
    last = F.when(k % 5 == 4, "").otherwise(F.concat(F.lit(" Peña-Ruiz"), F.floor(k / 3).cast("string")))
    people = V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person"),
        F.concat(pick(5, "José ", "Ana María ", "Zoë", "Bob J. ", " "), last).alias("full_name"),
        pick(4, "Pepe", None, "Zoë", "").alias("preferred_name"),
        pick(7, "Council President", "City Clerk", "Deputy Mayor", None, "Vice Speaker Pro Tem", "Vice  Chair", "Mayor").alias("title"),
    )
    return R.alias_index(people)


@query("""with recursive m as (select c_custkey as source, case when c_custkey % 16 < 15 then c_custkey + 1 when c_custkey // 16 % 5 = 0 then c_custkey - 9 end as target, c_name as display_name from customer),
t as (select * from m where target is not null),
walk as (select source, target, display_name from t union select w.source, t.target, t.display_name from walk w join t on w.target = t.source)
select source, target, display_name from walk where target not in (select source from t)""")
def profile_chains(spark, sf_dir):
    k = F.col("c_custkey")
    after = F.when(k % 16 < 15, k + 1).when(F.floor(k / 16) % 5 == 0, k - 9)
    return R.settle_moves(V.table(spark, sf_dir, "customer").select(k.alias("source"), after.alias("target"), F.col("c_name").alias("display_name")))

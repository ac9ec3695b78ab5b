"""Minutes with motions, written out from the order lines and read back; each with its DuckDB statement, which folds the results anew."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import reconcile as R
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.sources import motions as M

QUERIES, ORACLES, query = registry()
_SAYS = {"adopt": "that it be adopted", "amend": "to adopt Amendment 01 to it", "continue": "that it be postponed until the session to be held on ", "pull": "that it be withdrawn", "procedural": "that it be read by title"}
_LETTERS = "abcdefghij"

#: An order is an item, its lines are motions; settled[i] is the line whose result motion i took, or 0.
_FOLD = f"""recursive r as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k,
    {list(_SAYS)}[l_partkey % 5 + 1] as kind, ['plain', 'none', 'adopt', 'amend'][l_suppkey % 4 + 1] as res, l_quantity::int as ayes, l_linenumber + l_partkey % 50 as nays from lineitem),
o as (select l_orderkey, count(*) as n, list(kind order by k) as kinds, list(res order by k) as ress from r group by 1),
f as (
  select l_orderkey, n, kinds, ress, 0 as step, list_transform(range(n), lambda x: 0::bigint) as st, 0 as dropped from o
  union all
  select l_orderkey, n, kinds, ress, k, case when t > 0 then list_transform(range(1, n + 1), lambda i: case when i = t then k else st[i] end) else st end, dropped + (ress[k] <> 'none' and t = 0)::int
  from (select *, coalesce(case when ress[k] = 'none' then 0 when ress[k] = 'plain' then case when st[k] = 0 then k else 0 end when ress[k] = kinds[k] and st[k] = 0 then k
      when ress[k] = 'amend' then case when len(free_amend) = 1 then free_amend[1] else 0 end else list_max(free_adopt) end, 0) as t
    from (select *, step + 1 as k, list_filter(range(1, n + 1), lambda i: kinds[i] = 'amend' and st[i] = 0) as free_amend, list_filter(range(1, n + 1), lambda i: kinds[i] = 'adopt' and st[i] = 0) as free_adopt from f where step < n))),
done as (select * from f where step = n),
m as (
  select d.l_orderkey, r.k, r.kind, r.l_suppkey, r.l_shipdate, v.ayes, v.nays, case v.l_returnflag when 'R' then 'FAILED' when 'A' then 'PASSED' end as tag, case when v.l_linestatus = 'F' and v.ayes = 2 then 2 else 0 end as named,
    coalesce(v.l_returnflag <> 'R' and v.ayes > v.nays, false) as carried
  from done d join r on r.l_orderkey = d.l_orderkey left join r v on v.l_orderkey = d.l_orderkey and v.k = d.st[r.k])"""


def _minutes(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = V.table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w))
    kind = F.col("l_partkey") % 5
    says = F.get(F.array(*[F.lit(x) for x in _SAYS.values()]), kind.cast("int"))
    date = F.when(kind == 2, F.date_format("l_shipdate", "MMMM d, yyyy")).otherwise("")
    mover = F.concat(F.lit("M"), F.translate(F.col("l_suppkey").cast("string"), "0123456789", _LETTERS))
    tag = F.when(F.col("l_returnflag") == "R", " FAILED").when(F.col("l_returnflag") == "A", "\nPASSED").otherwise("")
    names = F.when(F.col("l_linestatus") == "F", " (Ann, Bo)").otherwise("")
    told = F.get(F.array(F.lit(""), F.lit(None), F.lit(" to adopt it as amended"), F.lit(" to adopt Amendment 01 to it")), (F.col("l_suppkey") % 4).cast("int"))
    nays = F.col("l_linenumber") + F.col("l_partkey") % 50
    result = F.concat(F.lit(" The motion"), told, F.lit(" received a roll call\nvote of Ayes: "), F.col("l_quantity").cast("int").cast("string"), names, F.lit(", Nays: "), nays.cast("string"), F.lit(", Abstain: 0 (Di out of the room)."), tag)
    line = F.concat(mover, F.lit(" moved, and Bo De seconded "), says, date, F.lit("."), F.coalesce(result, F.lit("")))
    join = lambda n, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(n, c))), lambda x: x["x"]), "\n")
    items = r.groupBy("l_orderkey").agg(join("k", line.alias("x")).alias("body"))
    head = F.concat(F.lit("3."), F.col("l_orderkey").cast("string"), F.lit(". Resolution 2026-"), (F.col("l_orderkey") % 1000).cast("string"), F.lit(" on a matter\n"), F.col("body"))
    docs = items.groupBy(F.floor(F.col("l_orderkey") / 64).alias("doc")).agg(join("l_orderkey", head.alias("x")).alias("text"))
    return docs.select("doc", F.concat(F.lit("Minutes\n3. Legislation [7:01 pm]\n"), F.col("text"), F.lit("\nMemorandum prepared by the clerk\n3.9. Ordinance 2026-1")).alias("text"))


def _order(df):
    """The order that an item is, back from its number."""
    return df.withColumn("l_orderkey", F.substring_index("item_number", ".", -1).cast("long"))


@query(f"""with {_FOLD} select l_orderkey // 64 as doc, dense_rank() over (partition by l_orderkey // 64 order by l_orderkey) as position, k as motion,
  'M' || translate(l_suppkey::varchar, '0123456789', '{_LETTERS}') as mover, kind, ayes, nays, named, tag, carried, case when kind = 'continue' then strftime(l_shipdate, '%Y-%m-%d') end as continued_to from m""")
def minutes_motions(spark, sf_dir):
    got = M.motions(_minutes(spark, sf_dir))
    return got.select("doc", "position", "motion", "mover", "kind", "ayes", F.col("nays").cast("long").alias("nays"), F.coalesce(F.size("ayes_names"), F.lit(0)).alias("named"), "tag", "carried", "continued_to")


@query(f"""with {_FOLD}, e as (select l_orderkey, k, case when kind = 'adopt' and tag = 'FAILED' then 'failed' when carried then case kind when 'adopt' then 'passed' when 'continue' then 'continued' when 'pull' then 'pulled' end end as how from m)
select l_orderkey, '7:01pm' as wallclock, 'Resolution 2026-' || (l_orderkey % 1000)::varchar as legislation_ref, n as n_motions, arg_max(how, k) filter (how is not null) as disposition, max(k) filter (how is not null) as decided_by, any_value(dropped)::bigint as dropped
from e join done using (l_orderkey) group by l_orderkey, n""")
def minutes_dispositions(spark, sf_dir):
    return _order(M.dispositions(_minutes(spark, sf_dir))).select("l_orderkey", "wallclock", "legislation_ref", "n_motions", "disposition", "decided_by", "dropped")


#: Agendas of the orders, some without an item, with another kind of act, or with a number that is not theirs; and the speakers of each document.
_AGENDA = """g as (select o_orderkey // 64 as doc, o_orderkey as item_id, case when o_custkey % 5 = 0 then 'Ordinance' else 'Resolution' end as act, '2026-' || ((o_orderkey - (o_custkey % 11 = 0)::int) % 1000)::varchar as num from orders where o_custkey % 7 > 0),
gr as (select doc, act, num, count(*) as n, min(item_id) as id from g group by all), gn as (select doc, num, count(*) as n, min(item_id) as id from g group by all),
i as (select distinct l_orderkey // 64 as doc, l_orderkey, '2026-' || (l_orderkey % 1000)::varchar as num from lineitem), ni as (select doc, num, count(*) as times from i group by all),
match as (
  select i.doc, i.l_orderkey, case when gr.n = 1 then gr.id when gr.n is null and gn.n = 1 and times = 1 then gn.id end as item_id,
    case when gr.n = 1 then 'exact' when gr.n > 1 then 'duplicate' when gn.n = 1 and times = 1 then 'number' when gn.n is not null then 'ambiguous' else 'none' end as matched_by
  from i join ni using (doc, num) left join gr on gr.doc = i.doc and gr.num = i.num and act = 'Resolution' left join gn on gn.doc = i.doc and gn.num = i.num)"""


def _agenda(spark, sf_dir):
    o, k = V.table(spark, sf_dir, "orders").where("o_custkey % 7 > 0"), F.col("o_orderkey")
    number = ((k - F.when(F.col("o_custkey") % 11 == 0, 1).otherwise(0)) % 1000).cast("string")
    act = F.when(F.col("o_custkey") % 5 == 0, "Ordinance 2026-").otherwise("Resolution 2026-")
    return o.select(F.floor(k / 64).alias("doc"), k.alias("item_id"), F.concat(act, number).alias("legislation_ref"), F.when(k % 2 == 0, "passed").alias("outcome"))


def _speakers(spark, sf_dir):
    """Zoe Ann and Bo in every document, Al Bo in each third."""
    who = F.explode(F.array(*[F.struct(F.lit(i).alias("speaker_id"), F.lit(n).alias("display_name")) for i, n in enumerate(["Zoe Ann", "Bo", "Al Bo"], 1)])).alias("s")
    docs = V.table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 64).alias("doc")).distinct()
    return docs.select("doc", who).select("doc", "s.*").where("speaker_id < 3 or doc % 3 = 0")


@query(f"""with {_FOLD}, {_AGENDA}, e as (select l_orderkey, k, case when kind = 'adopt' and tag = 'FAILED' then 'failed' when carried then case kind when 'adopt' then 'passed' when 'continue' then 'continued' when 'pull' then 'pulled' end end as how from m),
x as (select l_orderkey, arg_max(how, k) filter (how is not null) as outcome from e group by 1)
select doc, l_orderkey, item_id, matched_by, case when item_id is not null then outcome end as outcome, case when item_id % 2 = 0 and outcome is not null then 'passed' end as was from match join x using (l_orderkey)""")
def minutes_matches(spark, sf_dir):
    """The agenda item of each order in the minutes, and the outcome it gets."""
    ended = M.dispositions(_minutes(spark, sf_dir))
    agenda = _agenda(spark, sf_dir)
    matched = R.match_items(ended, agenda, "doc")
    updates = R.outcome_updates(ended, matched, agenda, "doc")
    return _order(matched.join(updates, ["doc", "item_id"], "left")).select("doc", "l_orderkey", "item_id", "matched_by", "outcome", "was")


@query(f"""with {_FOLD}, {_AGENDA} select doc, l_orderkey, k as motion, case when carried then case kind when 'continue' then 'Continued ' when 'pull' then 'Pulled ' else 'Passed ' end when tag = 'FAILED' or ayes < nays then 'Failed ' else '' end || ayes::varchar || '–' || nays::varchar as result, item_id,
  case when named = 0 then 0 when doc % 3 = 0 then 1 else 2 end as n_records, case when named = 2 and doc % 3 = 0 then 1 else 0 end::bigint as skipped
from m join match using (l_orderkey) where kind <> 'procedural' and ayes is not null""")
def minutes_votes(spark, sf_dir):
    """The votes to write, with the records of the members whom one speaker's name stands for."""
    told = M.parsed(_minutes(spark, sf_dir))
    items = M.dispositions_of(told)
    matched = R.match_items(items, _agenda(spark, sf_dir), "doc")
    votes = R.planned_votes(M.motions_of(told), matched, _speakers(spark, sf_dir), "doc").join(items.select("doc", "position", "item_number"), ["doc", "position"])
    return _order(votes).select("doc", "l_orderkey", "motion", "result", "item_id", F.size("records").alias("n_records"), "skipped")

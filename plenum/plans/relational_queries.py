"""Queues, pickers, statistics, keyed writes and scores; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import scoring as C
from plenum.operators import upsert as U
from plenum.plans import views as V
from plenum.plans.registry import registry

QUERIES, ORACLES, query = registry()
T = V.table
DAY = "cast(o_orderdate as date)"


@query("""select o_orderkey, o_custkey, c_name, n_name, o_orderpriority from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey and n_regionkey < 3
where o_orderstatus = 'P' order by n_name asc nulls last, o_orderdate asc nulls last, o_totalprice desc nulls last, o_orderkey desc limit 200""")
def pending_queue(spark, sf_dir):
    o, c, n = T(spark, sf_dir, "orders"), T(spark, sf_dir, "customer"), T(spark, sf_dir, "nation").where("n_regionkey < 3")
    return (
        o.where("o_orderstatus = 'P'")
        .join(c, o.o_custkey == c.c_custkey, "left")
        .join(n, c.c_nationkey == n.n_nationkey, "left")
        .orderBy(F.asc_nulls_last("n_name"), F.asc_nulls_last("o_orderdate"), F.desc_nulls_last("o_totalprice"), F.desc("o_orderkey"))
        .limit(200)
        .select("o_orderkey", "o_custkey", "c_name", "n_name", "o_orderpriority")
    )


@query("""select l_suppkey as outlet, count(*) filter (l_returnflag = 'R') as rejected, count(*) filter (l_returnflag = 'A') as accepted, count(*) filter (l_returnflag = 'N' and l_linestatus = 'O') as pending, count(*) as total,
  round(sum(l_extendedprice) filter (l_returnflag = 'R') / sum(l_extendedprice), 4) as rejected_share from lineitem group by 1 having count(*) filter (l_returnflag = 'R') > 0""")
def outlet_stats(spark, sf_dir):
    return (
        T(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("outlet"))
        .agg(
            F.count_if(F.col("l_returnflag") == "R").alias("rejected"),
            F.count_if(F.col("l_returnflag") == "A").alias("accepted"),
            F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("pending"),
            F.count("*").alias("total"),
            F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))) / F.sum("l_extendedprice"), 4).alias("rejected_share"),
        )
        .where("rejected > 0")
    )


@query(f"""with t as (select max({DAY}) as today from orders)
select c_custkey as race, c_name from customer where exists (select 1 from orders, t where o_custkey = c_custkey and {DAY} between today - 700 and today)
and not exists (select 1 from orders, t where o_custkey = c_custkey and {DAY} >= today - 365 and o_orderstatus in ('O', 'P'))""")
def alarm_races(spark, sf_dir):
    o = T(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    o = o.join(F.broadcast(o.agg(F.max("day").alias("today"))), F.lit(True))  # one row
    recent = o.where("day between today - interval 700 days and today").select(F.col("o_custkey").alias("c_custkey")).distinct()
    active = o.where("day >= today - interval 365 days and o_orderstatus in ('O', 'P')").select(F.col("o_custkey").alias("c_custkey")).distinct()
    c = T(spark, sf_dir, "customer")
    return c.join(recent, "c_custkey", "left_semi").join(active, "c_custkey", "left_anti").select(F.col("c_custkey").alias("race"), "c_name")


@query(f"""with t as (select max({DAY}) as today from orders)
select c_custkey, c_name, o_orderkey, {DAY} as day from customer join orders on c_custkey = o_custkey, t where o_orderstatus in ('O', 'P') and {DAY} >= today - 200 and coalesce(o_orderpriority, '') not in ('5-LOW', '4-NOT SPECIFIED') order by day, c_name, o_orderkey""")
def tracked_candidates(spark, sf_dir):
    o = T(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    o = o.join(F.broadcast(o.agg(F.max("day").alias("today"))), F.lit(True)).where("o_orderstatus in ('O', 'P') and day >= today - interval 200 days")
    o = o.where(~F.coalesce("o_orderpriority", F.lit("")).isin("5-LOW", "4-NOT SPECIFIED"))
    c = T(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name", "o_orderkey", "day").orderBy("day", "c_name", "o_orderkey")


@query("""with p as (select c_custkey, c_name, n_name, r_name, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where (c_name ilike '%1%' or n_name ilike '%an%') and c_custkey in (select o_custkey from orders where o_orderstatus <> 'P')),
l as (select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate desc, o_orderkey desc) as recent from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k <= 3 group by o_custkey)
select c_custkey, c_name, n_name, r_name, recent from p left join l on c_custkey = o_custkey where n = 1 order by recent is null, c_name limit 50""")
def politician_picker(spark, sf_dir):
    c, n, r, o = (T(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    people = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).where(F.col("c_name").ilike("%1%") | F.col("n_name").ilike("%an%"))
    people = people.join(o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    one = people.withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("n = 1")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("recent")
    )
    return one.join(last, one.c_custkey == last.o_custkey, "left").select("c_custkey", "c_name", "n_name", "r_name", "recent").orderBy(F.col("recent").isNull(), "c_name").limit(50)


@query("""select p_partkey, p_name, p_brand, p_size from part left join (select l_partkey, max(l_shipdate) as last_ship from lineitem where l_returnflag = 'A' group by 1) on p_partkey = l_partkey
where p_brand ilike 'brand%1%' and (p_type ilike '%small%' or p_type ilike '%eco%' or p_name ilike '%a%') order by last_ship desc nulls last, p_size asc, p_name asc nulls first, p_partkey limit 100""")
def race_search(spark, sf_dir):
    p = T(spark, sf_dir, "part").where(F.col("p_brand").ilike("brand%1%") & (F.col("p_type").ilike("%small%") | F.col("p_type").ilike("%eco%") | F.col("p_name").ilike("%a%")))
    last = T(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_ship"))
    return (
        p.join(last, p.p_partkey == last.l_partkey, "left")
        .orderBy(F.desc_nulls_last("last_ship"), "p_size", F.asc_nulls_first("p_name"), "p_partkey")
        .limit(100)
        .select("p_partkey", "p_name", "p_brand", "p_size")
    )


@query("select c_custkey, c_name, c_acctbal from customer order by c_acctbal < 0, c_name like '%9', c_acctbal desc, c_custkey limit 25")
def topk_people(spark, sf_dir):
    return T(spark, sf_dir, "customer").orderBy(F.col("c_acctbal") < 0, F.col("c_name").like("%9"), F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name", "c_acctbal")


@query("select event_id, ts, event_type from events order by ts, event_id limit 200 offset 400")
def page_segments(spark, sf_dir):
    return T(spark, sf_dir, "events").orderBy("ts", "event_id").offset(400).limit(200).select("event_id", "ts", "event_type")


@query("""select 'segment' as facet, c_mktsegment as value, count(*) as n from customer group by 2 union all select 'nation', n_name, count(*) from customer join nation on c_nationkey = n_nationkey group by 2
union all select 'status', o_orderstatus, count(distinct o_custkey) from orders group by 2""")
def facet_counts(spark, sf_dir):
    c, n, o = (T(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    a = c.groupBy(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))
    b = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.lit("nation").alias("facet"), F.col("n_name").alias("value")).agg(F.count("*").alias("n"))
    d = o.groupBy(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")).agg(F.count_distinct("o_custkey").alias("n"))
    return a.unionByName(b).unionByName(d)


@query("""select p_type as topic, count(distinct l_orderkey) as n_meetings, count(l_orderkey) as n_items, count(distinct p_partkey) as n_parts from part left join lineitem on p_partkey = l_partkey and l_returnflag = 'R' group by 1
union all select '(none)', count(distinct l_orderkey), count(*), 0 from lineitem l where not exists (select 1 from part where p_partkey = l_partkey and p_size < 25)""")
def topics_index(spark, sf_dir):
    p, li = T(spark, sf_dir, "part"), T(spark, sf_dir, "lineitem")
    r = li.where("l_returnflag = 'R'")
    topics = p.join(r, p.p_partkey == r.l_partkey, "left").groupBy(F.col("p_type").alias("topic")).agg(
        F.count_distinct("l_orderkey").alias("n_meetings"), F.count("l_orderkey").alias("n_items"), F.count_distinct("p_partkey").alias("n_parts")
    )
    small = p.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    rest = li.join(small, "l_partkey", "left_anti").agg(F.lit("(none)").alias("topic"), F.count_distinct("l_orderkey").alias("n_meetings"), F.count("*").alias("n_items"), F.lit(0).cast("long").alias("n_parts"))
    return topics.unionByName(rest)


@query(f"""select c_custkey, coalesce(c_name, max(o_orderpriority)) as name, count(o_orderkey) as n, count(distinct {DAY}) as n_days, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses, max({DAY}) as last_day
from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name""")
def people_roster(spark, sf_dir):
    c, o = T(spark, sf_dir, "customer"), T(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey", "c_name").agg(
        F.max("o_orderpriority").alias("p"), F.count("o_orderkey").alias("n"), F.count_distinct("day").alias("n_days"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.max("day").alias("last_day"),
    ).select("c_custkey", F.coalesce("c_name", "p").alias("name"), "n", "n_days", F.nullif("statuses", F.lit("")).alias("statuses"), "last_day")


@query("""with t as (select max(ts) as now from events), l as (select user_id, max(ts) as last_polled from events where event_type = 'click' group by 1)
select u.user_id, last_polled, last_polled is null as never, not exists (select 1 from events e, t where e.user_id = u.user_id and e.event_type = 'error' and e.ts >= now - interval 36 hours) as overdue
from (select distinct user_id from events) u left join l on u.user_id = l.user_id, t where last_polled is null or last_polled < now - interval 48 hours""")
def stale_outlets(spark, sf_dir):
    e = T(spark, sf_dir, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_polled"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_run"))
    return last.join(now, F.lit(True)).where("last_polled is null or last_polled < now - interval 48 hours").select(
        "user_id", "last_polled", F.col("last_polled").isNull().alias("never"), (~F.coalesce(F.col("last_run") >= F.expr("now - interval 36 hours"), F.lit(False))).alias("overdue")
    )


@query("select o_orderkey, o_orderstatus, count(l_orderkey) as n_records from orders left join lineitem on o_orderkey = l_orderkey and l_returnflag = 'R' group by 1, 2")
def vote_counts(spark, sf_dir):
    o, li = T(spark, sf_dir, "orders"), T(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("n_records"))


@query("""select s_suppkey, s_name, coalesce(parts, '') as parts from supplier left join (select l_suppkey, string_agg(p_name, '|' order by p_name) as parts from (select distinct l_suppkey, l_partkey from lineitem where l_quantity >= 45) join part on l_partkey = p_partkey group by 1) on s_suppkey = l_suppkey""")
def nested_roster(spark, sf_dir):
    s, p = T(spark, sf_dir, "supplier"), T(spark, sf_dir, "part")
    li = T(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_suppkey", "l_partkey").distinct()
    held = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "|").alias("parts"))
    return s.join(held, s.s_suppkey == held.l_suppkey, "left").select("s_suppkey", "s_name", F.coalesce("parts", F.lit("")).alias("parts"))


@query("""select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders) order by rn, o_orderpriority limit 60""")
def round_robin_sample(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return T(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).orderBy("rn", "o_orderpriority").limit(60).select("o_orderkey", "o_orderpriority")


@query("select user_id, arg_min(event_id, (ts, event_id)) as first_event, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def first_per_channel(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return T(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_event"), F.max_by("event_type", at).alias("last_type"))


@query("select p_partkey, p_name, case when count(*) over (partition by lower(p_name)) > 1 then 'one of ' || (count(*) over (partition by lower(p_name)))::varchar end as note from part")
def mark_duplicates(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy(F.lower("p_name")))
    return T(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(n > 1, F.concat(F.lit("one of "), n.cast("string"))).alias("note"))


@query("select p_brand, p_size, min(p_partkey) as p_partkey from part group by 1, 2 having count(*) = 1")
def unique_lookup(spark, sf_dir):
    return T(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1").drop("n")


@query("select user_id, arg_max(event_type, (c, -first)) as modal from (select user_id, event_type, count(*) as c, min(event_id) as first from events group by 1, 2) group by 1")
def modal_value(spark, sf_dir):
    e = T(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.min("event_id").alias("first"))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("c", -F.col("first"))).alias("modal"))


# keyed writes: customers are the stored rows; sums of their orders are the changes


def _stored(spark, sf_dir):
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).otherwise(" ").alias("label"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey")).alias("place"))


def _changes(spark, sf_dir):
    return T(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy((F.col("o_custkey") + 700).alias("id")).agg(F.max("o_orderpriority").alias("label"), F.count("*").cast("int").alias("place"))


_STATE = """with s as (select c_custkey as id, case when c_custkey % 4 > 0 then c_mktsegment else ' ' end as label, case when c_custkey % 5 > 0 then c_nationkey end as place from customer),
x as (select o_custkey + 700 as id, max(o_orderpriority) as label, count(*)::integer as place from orders where o_orderstatus = 'P' group by 1)"""


@query(_STATE + " select * from s where not exists (select 1 from x where x.id = s.id) union all select * from x")
def keyed_upsert(spark, sf_dir):
    return U.upsert(_stored(spark, sf_dir), _changes(spark, sf_dir), ["id"])


@query(_STATE + " select * from s union all select * from x where not exists (select 1 from s where x.id = s.id)")
def insert_if_absent(spark, sf_dir):
    return U.insert_if_absent(_stored(spark, sf_dir), _changes(spark, sf_dir), ["id"], ["label"])


@query(_STATE + " select s.id, coalesce(nullif(trim(s.label), ''), x.label) as label, coalesce(s.place, x.place) as place from s left join x on s.id = x.id")
def fill_only_update(spark, sf_dir):
    return U.fill_only(_stored(spark, sf_dir), _changes(spark, sf_dir), ["id"], ["label", "place"])


@query("""with t as (select l_orderkey, l_linenumber, l_returnflag, l_partkey from lineitem), x as (select o_orderkey as l_orderkey, 0 as l_linenumber, 'R' as l_returnflag, o_custkey as l_partkey from orders where o_orderstatus = 'P')
select * from t where not (l_returnflag = 'R' and l_orderkey in (select l_orderkey from x)) union all select * from x""")
def stripe_replace(spark, sf_dir):
    t = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    x = T(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("R").alias("l_returnflag"), F.col("o_custkey").alias("l_partkey"))
    return U.replace_stripe(t, x, F.col("l_returnflag") == "R", ["l_orderkey"])


@query(_STATE + """ select s.id, case when x.label is not null and s.place is not null and s.label is distinct from x.label then x.label else s.label end as label, s.place,
coalesce(x.label is not null and s.place is not null and s.label is distinct from x.label, false) as changed from s left join x on s.id = x.id""")
def conditional_update(spark, sf_dir):
    return U.update_where(_stored(spark, sf_dir), _changes(spark, sf_dir).drop("place"), ["id"], "label", F.col("place").isNotNull())


@query("""with d as (select o_orderkey from orders where o_orderpriority = '1-URGENT') select 'lineitem' as "table", count(*) filter (l_orderkey in (select o_orderkey from d)) as deleted, count(*) filter (l_orderkey not in (select o_orderkey from d)) as kept from lineitem
union all select 'orders', count(*) filter (o_orderkey in (select o_orderkey from d)), count(*) filter (o_orderkey not in (select o_orderkey from d)) from orders""")
def cascade_delete(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    li = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.delete_cascade({"lineitem": li, "orders": o}, "o_orderkey", o.where("o_orderpriority = '1-URGENT'"))


@query("""with p as (select l_orderkey % 500 as ref, l_returnflag as result from lineitem where l_linenumber <= 3), a as (select l_orderkey % 500 as ref, l_returnflag as result from lineitem where l_linenumber >= 3),
m as (select * from p except all select * from a), e as (select * from a except all select * from p)
select ref, result, 'missing' as side, count(*) as n from m group by 1, 2 union all select ref, result, 'extra', count(*) from e group by 1, 2""")
def multiset_drift(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("ref"), F.col("l_returnflag").alias("result"), "l_linenumber")
    return U.multiset_drift(li.where("l_linenumber <= 3").drop("l_linenumber"), li.where("l_linenumber >= 3").drop("l_linenumber"))


@query("""select coalesce(a.k, b.k) as k, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'left' else 'right' end as side
from (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_quantity > 40) a full join (select p_partkey as k from part where p_size < 30) b on a.k = b.k""")
def key_partition(spark, sf_dir):
    a = T(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("k"))
    return U.partition_keys(a, T(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("k")), "k")


@query("""with c as (select l_orderkey, count(*) as n from lineitem group by 1) select o_orderkey, case when c.n is null then 'missing' when c.n <> o_custkey % 7 + 1 then 'count' when o_totalprice > 200000 then 'amount' end as drift
from orders left join c on o_orderkey = l_orderkey where c.n is null or c.n <> o_custkey % 7 + 1 or o_totalprice > 200000""")
def drift_check(spark, sf_dir):
    c = T(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = T(spark, sf_dir, "orders")
    drift = F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("o_custkey") % 7 + 1, "count").when(F.col("o_totalprice") > 200000, "amount")
    return o.join(c, o.o_orderkey == c.l_orderkey, "left").select("o_orderkey", drift.alias("drift")).where("drift is not null")


@query(_STATE + " select coalesce(s.id, x.id) as id, coalesce(s.label, x.label) as label, coalesce(s.place, x.place) as place from s full join x on s.id = x.id")
def merge_examples(spark, sf_dir):
    s, x = _stored(spark, sf_dir), _changes(spark, sf_dir).toDF("id", "l", "p")
    return s.join(x, "id", "full_outer").select("id", F.coalesce("label", "l").alias("label"), F.coalesce("place", "p").alias("place"))


# scores: gold from labels, predictions from rules on the documents


@query("""with r as (select source, quality = 1 as gold, case when n_chars % 13 > 0 then n_chars > 500 end as predicted from labels join documents using (doc_id)),
c as (select source, count(*) filter (gold and predicted) as tp, count(*) filter (not gold and predicted) as fp, count(*) filter (gold and not predicted) as fn, count(*) filter (not gold and not predicted) as tn, count(*) filter (predicted is null) as failed, count(*) as n from r group by 1)
select *, round(tp / nullif(tp + fp, 0), 4) as precision, round(tp / nullif(tp + fn, 0), 4) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) as f1 from c""")
def confusion_prf(spark, sf_dir):
    r = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return C.confusion(r, F.col("quality") == 1, F.when(F.col("n_chars") % 13 > 0, F.col("n_chars") > 500), ["source"])


@query("""with r as (select (n_chars % 1001) / 1000.0 as p, quality::double as y from labels join documents using (doc_id))
select least(floor(p * 5), 4)::bigint as bucket, count(*) as n, round(avg(p), 4) as mean_predicted, round(avg(y), 4) as mean_actual, round(sum((p - y) * (p - y)), 4) as squared_error from r group by 1""")
def brier_buckets(spark, sf_dir):
    r = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(((F.col("n_chars") % 1001) / 1000.0).cast("double").alias("p"), F.col("quality").cast("double").alias("y"))
    return C.calibration(r, F.col("p"), F.col("y"))


@query("""select lang, count(*) as n, round(avg((toxic = (n_chars % 3 = 0)::int)::int), 4) as accuracy, count(*) filter (toxic = 1 and n_chars % 3 <> 0) as missed from labels join documents using (doc_id) group by 1""")
def tier_accuracy(spark, sf_dir):
    r = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    said = (F.col("n_chars") % 3 == 0).cast("int")
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("toxic") == said).cast("int")), 4).alias("accuracy"), F.count_if((F.col("toxic") == 1) & (said == 0)).alias("missed"))


_SECTIONS = """with g as (select l_suppkey as grp, l_orderkey * 100 + l_linenumber as ordinal, l_returnflag as type, (l_partkey % 40)::integer as first, (l_partkey % 40 + l_quantity::bigint % 9 - 1)::integer as last from lineitem where l_linenumber <= 2),
o as (select l_suppkey as grp, l_orderkey * 100 + l_linenumber as ordinal, l_returnflag as type, (l_partkey % 40)::integer as first, (l_partkey % 40 + l_quantity::bigint % 9 - 1)::integer as last from lineitem where l_linenumber > 2)"""


def _sections(spark, sf_dir, where):
    li = T(spark, sf_dir, "lineitem").where(where)
    first = (F.col("l_partkey") % 40).cast("int")
    return li.select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("type"), first.alias("first"), (first + (F.col("l_quantity").cast("long") % 9).cast("int") - 1).alias("last"))


@query(_SECTIONS + """, ge as (select grp, ordinal, type, unnest(generate_series(first, last)) as position from g where last >= first), oe as (select grp, ordinal, type, unnest(generate_series(first, last)) as position from o where last >= first),
gl as (select grp, position, arg_max(type, (ordinal, type)) as type from ge group by 1, 2), ol as (select grp, position, arg_max(type, (ordinal, type)) as type from oe group by 1, 2)
select gl.grp, count(*) as n, count(*) filter (gl.type = ol.type) as n_same, round(count(*) filter (gl.type = ol.type) / count(*), 4) as share from gl left join ol on gl.grp = ol.grp and gl.position = ol.position group by 1""")
def label_agreement(spark, sf_dir):
    tie = lambda df: df.withColumn("ordinal", F.struct("ordinal", "type"))
    gold = C.label_positions(tie(_sections(spark, sf_dir, "l_linenumber <= 2")), "grp")
    return C.agreement(gold, C.label_positions(tie(_sections(spark, sf_dir, "l_linenumber > 2")), "grp"), "grp")


@query(_SECTIONS + """, s as (select grp, list_sort(list(distinct first)) as b, 'g' as side from g where first between 1 and 39 group by grp union all select grp, list_sort(list(distinct first)), 'o' from o where first between 1 and 39 group by grp)
select grp, sum(len(b)) filter (side = 'g')::bigint as n_gold, sum(len(b)) filter (side = 'o')::bigint as n_candidates from s group by grp""")
def section_boundaries(spark, sf_dir):
    g = _sections(spark, sf_dir, "l_linenumber <= 2").where("first between 1 and 39").groupBy("grp").agg(F.count_distinct("first").alias("n_gold"))
    o = _sections(spark, sf_dir, "l_linenumber > 2").where("first between 1 and 39").groupBy("grp").agg(F.count_distinct("first").alias("n_candidates"))
    return g.join(o, "grp", "full_outer")


@query("""with recursive x as (select l_suppkey as grp, l_linenumber % 2 as odd, (l_partkey % 40)::integer as first from lineitem where l_partkey % 40 between 1 and 39),
b as (select grp, coalesce(list_sort(list(distinct first) filter (odd = 1)), []) as gold, coalesce(list_sort(list(distinct first) filter (odd = 0)), []) as found from x group by grp),
f as (
  select grp, gold, found, 0 as i, 0 as hits, 0 as past from b
  union all
  select grp, gold, found, i + 1, hits + (j > 0)::int, past + j
  from (select *, coalesce(list_position(list_transform(found[past + 1:], lambda c: abs(c - gold[i + 1]) <= 1), true), 0)::int as j from f where i < len(gold)))
select grp, hits::bigint as matched, len(gold)::bigint as n_gold, len(found)::bigint as n_found from f where i = len(gold)""")
def boundary_counts(spark, sf_dir):
    """Greedy one-to-one matches of section starts: those of odd lines against those of even lines."""
    starts = lambda w: _sections(spark, sf_dir, w).where("first between 1 and 39").groupBy("grp").agg(F.array_sort(F.collect_set("first")).alias("s"))
    g, c = starts("l_linenumber % 2 = 1").toDF("grp", "gold"), starts("l_linenumber % 2 = 0").toDF("grp", "found")
    both = g.join(c, "grp", "full_outer").select("grp", F.coalesce("gold", F.array().cast("array<int>")).alias("gold"), F.coalesce("found", F.array().cast("array<int>")).alias("found"))
    return both.select("grp", C.matched_boundaries(F.col("gold"), F.col("found")).cast("long").alias("matched"), F.size("gold").cast("long").alias("n_gold"), F.size("found").cast("long").alias("n_found"))


@query("""with m as (select source, count(*) filter (quality = 1) as hit, count(*) as n, count(*) filter (toxic = 1) as bad from labels join documents using (doc_id) group by 1)
select sum(hit)::bigint as hit, sum(n)::bigint as n, round(sum(hit) / sum(n), 4) as micro, round(avg(hit / n), 4) as macro, round(avg(abs(hit - bad)), 4) as mean_delta from m""")
def micro_average(spark, sf_dir):
    r = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    m = r.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("hit"), F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"))
    return m.agg(
        F.sum("hit").alias("hit"), F.sum("n").alias("n"), F.round(F.sum("hit") / F.sum("n"), 4).alias("micro"),
        F.round(F.avg(F.col("hit") / F.col("n")), 4).alias("macro"), F.round(F.avg(F.abs(F.col("hit") - F.col("bad"))), 4).alias("mean_delta"),
    )

"""Queries over rule tables, anchors, spoken names and lookups; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import matching as M
from plenum.plans import views as V
from plenum.plans.registry import registry

QUERIES, ORACLES, query = registry()
T = V.table


@query("""with r(ordinal, keyword, value) as (values (1, 'SMALL', 'minor'), (2, 'eco', 'budget'), (3, 'a', 'general'))
select p_partkey, (select arg_min(value, ordinal) from r where contains(lower(p_type), lower(keyword))) as value from part""")
def first_rule(spark, sf_dir):
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("keyword"), F.lit(v).alias("value")) for i, k, v in ((1, "SMALL", "minor"), (2, "eco", "budget"), (3, "a", "general"))])))
    return M.first_rule(T(spark, sf_dir, "part"), rules, "p_partkey", "p_type")


@query("""with i as (select p_partkey as item_id, p_partkey % 1500 as ref from part), o as (select ref, min(item_id) as item_id from i group by 1 having count(*) = 1),
s as (select l_orderkey, l_partkey as ref from lineitem union select l_orderkey, l_suppkey from lineitem)
select item_id, array_to_string(list_sort(list(distinct l_orderkey)), ',') as segments from s join o on o.ref = s.ref group by 1""")
def reference_anchors(spark, sf_dir):
    items = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("Ordinance 2026-"), (F.col("p_partkey") % 1500).cast("string")).alias("ref"))
    li = T(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("On Ordinance 2026-"), F.col("l_partkey").cast("string"), F.lit(" and Ordinance 2026-"), F.col("l_suppkey").cast("string"), F.lit(". ")).alias("t"))
    segments = li.groupBy(F.col("l_orderkey").alias("segment_id")).agg(F.array_join(F.collect_list("t"), "").alias("text"))
    got = M.anchors(items, segments, r"Ordinance \d{4}-\d+")
    return got.select("item_id", F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments"))


@query("""with c as (select c_custkey, 'Jo ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as name, c_custkey % 7 as k from customer)
select c_custkey as segment_id, case k when 0 then 'self_identification' when 1 then 'chair_recognition' when 2 then 'roll_call' when 3 then 'name_addressing' else 'title_context' end as family,
case when k = 4 then 'Attorney' else name end as name, case k when 0 then 0.90 when 1 then 0.92 when 2 then 0.95 when 3 then 0.80 else 0.75 end::double as confidence from c where k < 5""")
def spoken_names(spark, sf_dir):
    """Names that five families of sentences tell; the sixth names without a title, the seventh nobody."""
    name = F.concat(F.lit("Jo "), F.initcap("c_mktsegment"))
    k = F.col("c_custkey") % 7
    said = (
        F.when(k == 0, F.concat(F.lit("Good evening, I am Council Member "), name, F.lit(". I live here.")))
        .when(k == 1, F.concat(F.lit("the Chair recognizes vice mayor "), name, F.lit(" now")))
        .when(k == 2, F.concat(F.lit("Councilmember "), name, F.lit(" ?")))
        .when(k == 3, F.concat(F.lit("Clerk "), name, F.lit(", would you")))
        .when(k == 4, "Speaking as the city attorney. Clerk Here?")
        .when(k == 5, F.concat(F.lit("I am "), name, F.lit(".")))
        .otherwise("nothing to see")
    )
    return M.spoken_names(T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id"), said.alias("text")))


@query("""with s as (select *, [case when lead(user_id % 5, 1) over w <> user_id % 5 and lead(event_type, 1) over w in ('click', 'view') then lead(user_id % 5, 1) over w end, case when lead(user_id % 5, 2) over w <> user_id % 5 and lead(event_type, 2) over w in ('click', 'view') then lead(user_id % 5, 2) over w end,
case when lead(user_id % 5, 3) over w <> user_id % 5 and lead(event_type, 3) over w in ('click', 'view') then lead(user_id % 5, 3) over w end, case when lead(user_id % 5, 4) over w <> user_id % 5 and lead(event_type, 4) over w in ('click', 'view') then lead(user_id % 5, 4) over w end] as l
from events window w as (partition by cast(ts as date) order by event_id)) select cast(ts as date) as meeting, event_id as segment_id, list_filter(l, lambda x: x is not null)[1]::varchar as responder from s""")
def roll_call_responder(spark, sf_dir):
    e = T(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "click", "Yes.").when(F.col("event_type") == "view", "I'm here").otherwise("heresy")
    return M.roll_call_responder(e.select(F.to_date("ts").alias("meeting"), F.col("event_id").alias("segment_id"), (F.col("user_id") % 5).cast("string").alias("label"), said.alias("text")))


@query("""with e as (select o_orderkey as position, 'l' || (o_custkey % 900)::varchar as link, case when o_orderkey % 2 = 0 then 's' else '' end || (o_custkey % 1300)::varchar as slug, o_orderpriority as value from orders),
a as (select c_custkey as ask_id, 'l' || (c_custkey + 400)::varchar as link, case when c_custkey % 3 > 0 then 's' else '' end || c_custkey::varchar as slug from customer)
select ask_id, coalesce(l.v, s.v) as value, case when l.v is not null then 1 when s.v is not null then 2 end::bigint as tier from a
left join (select link, arg_min(value, position) as v from e group by 1) l on a.link = l.link left join (select slug, arg_min(value, position) as v from e group by 1) s on a.slug = s.slug and not regexp_full_match(a.slug, '\\d+')""")
def tiered_lookup(spark, sf_dir):
    text = lambda c: c.cast("string")
    o = T(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("position"), F.concat(F.lit("l"), text(F.col("o_custkey") % 900)).alias("link"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "s").otherwise(""), text(F.col("o_custkey") % 1300)).alias("slug"), F.col("o_orderpriority").alias("value"))
    c = F.col("c_custkey")
    a = T(spark, sf_dir, "customer").select(c.alias("ask_id"), F.concat(F.lit("l"), text(c + 400)).alias("link"), F.concat(F.when(c % 3 > 0, "s").otherwise(""), text(c)).alias("slug"))
    return M.tiered_lookup(a, e)


@query("""select l_orderkey, arg_max(l_shipdate::varchar || l_returnflag, (l_linenumber, l_partkey, l_suppkey)) filter (l_quantity > 20 and l_returnflag <> 'N') as outcome, count(*) filter (l_quantity > 20 and l_returnflag <> 'N') as n_deciding from lineitem group by 1""")
def last_disposition(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    said = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_returnflag"))
    return M.last_disposition(li, ["l_orderkey"], (F.col("l_quantity") > 20) & (F.col("l_returnflag") != "N"), said, ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""with s as (select l_suppkey as grp, l_partkey * 3 as first, l_partkey * 3 + l_linenumber as last, l_returnflag as type, l_linestatus || l_orderkey::varchar as title from lineitem),
c as (select *, case when lag(type) over w = type and first <= max(last) over (partition by grp order by first, last, title rows between unbounded preceding and 1 preceding) + 2 then 0 else 1 end as cut from s window w as (partition by grp order by first, last, title)),
i as (select *, sum(cut) over (partition by grp order by first, last, title rows between unbounded preceding and current row)::bigint as island from c)
select grp, island, min(type) as type, min(first) as first, max(last) as last, arg_max(title, (length(title), title)) as title, count(*) as n from i group by 1, 2""")
def chunk_sections(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") * 3).alias("first"), (F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("last"), F.col("l_returnflag").alias("type"), F.concat("l_linestatus", F.col("l_orderkey").cast("string")).alias("title"))
    return M.chunk_sections(li, "grp", 2)


@query("""with s as (select o_orderkey as id, o_custkey as slug, o_orderstatus as status from orders where o_custkey % 3 > 0), x as (select o_orderkey as id, o_custkey + 1 as slug, 'N' as status from orders where o_custkey % 3 < 2)
select coalesce(s.id, x.id) as id, case when s.status = 'F' or x.id is null then s.slug else x.slug end as slug, case when s.status = 'F' or x.id is null then s.status else x.status end as status,
case when s.id is null then 'inserted' when x.id is null then 'kept' when s.status = 'F' then 'skipped' else 'updated' end as action from s full join x on s.id = x.id""")
def conditional_upsert(spark, sf_dir):
    """Scheduled rows replace stored ones unless these are final; a third of the orders is stored only, a third scheduled only, a third both."""
    o = T(spark, sf_dir, "orders")
    s = o.where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("slug"), F.col("o_orderstatus").alias("status")).alias("old"))
    x = o.where("o_custkey % 3 < 2").select(F.col("o_orderkey").alias("id"), F.struct((F.col("o_custkey") + 1).alias("slug"), F.lit("N").alias("status")).alias("new"))
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("old.status") == "F", "skipped").otherwise("updated")
    j = s.join(x, "id", "full_outer").withColumn("action", action)
    chosen = F.when(F.col("action").isin("kept", "skipped"), F.col("old")).otherwise(F.col("new"))
    return j.select("id", chosen["slug"].alias("slug"), chosen["status"].alias("status"), "action")

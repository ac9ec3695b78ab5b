"""Row decisions, documents, reconciliation plans and reports; each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions import rules as R
from plenum.operators import intervals as I
from plenum.plans import views as V
from plenum.plans.registry import registry
from plenum.plans.views import SECTIONS, TURNS

QUERIES, ORACLES, query = registry()
T = V.table


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'essentials:p-' || c_custkey::varchar when c_custkey % 3 = 1 and c_custkey % 2 = 0 then 'local:l-' || c_custkey::varchar
else 'name:' || lower(c_name) end as key from customer""")
def identity_keys(spark, sf_dir):
    c = T(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    a = F.when(k % 3 == 0, F.concat(F.lit("p-"), k.cast("string"))).otherwise(" ")
    b = F.when((k % 3 == 1) & (k % 2 == 0), F.concat(F.lit("l-"), k.cast("string")))
    return c.select("c_custkey", R.identity_key(a, b, F.concat(F.lit("Dr. "), "c_name")).alias("key"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then 'SPEAKER_' || lpad((l_partkey % 150)::varchar, greatest(2, length((l_partkey % 150)::varchar))::integer, '0') else 'MR_CHAIR' end as label from lineitem""")
def speaker_labels(spark, sf_dir):
    said = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("speaker "), (F.col("l_partkey") % 150).cast("string"), F.lit(" "))).otherwise(" mr. chair")
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.speaker_label(said).alias("label"))


@query("select o_orderkey, ('0x' || substr(sha256(o_orderkey::varchar || '|' || o_orderstatus), 1, 16))::ubigint::varchar as seed from orders")
def pair_seeds(spark, sf_dir):
    return T(spark, sf_dir, "orders").select("o_orderkey", R.seed(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).cast("string").alias("seed"))


@query("""with o as (select o_custkey, list(o_orderpriority order by o_orderkey) as l from orders group by 1),
d as (select o_custkey, l, list_filter(l, lambda x, i: x in ('1-URGENT', '3-MEDIUM', '5-LOW') and list_position(l, x) = i) as kept from o)
select o_custkey, array_to_string(kept, ',') as topics, array_to_string(list_slice(l, 1, 3), ', ') || case when len(l) > 3 then ' +' || (len(l) - 3)::varchar || ' more' else '' end as shown from d""")
def topic_keys(spark, sf_dir):
    o = T(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("l"))
    vocabulary = F.array(*[F.lit(x) for x in ("5-LOW", "1-URGENT", "3-MEDIUM")])
    return o.select("o_custkey", F.array_join(R.in_vocabulary(F.col("l"), vocabulary), ",").alias("topics"), R.first_and_more(F.col("l")).alias("shown"))


@query("""with p as (select p_size, list(case when p_partkey % 2 = 0 then upper(p_brand) else p_brand end order by p_partkey) as l from part group by 1)
select p_size, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ',') as brands from p""")
def case_dedupe(spark, sf_dir):
    b = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    # of equal spellings the first part's is enough, and few spellings are left
    each = T(spark, sf_dir, "part").groupBy("p_size", b.alias("b")).agg(F.min("p_partkey").alias("p_partkey"))
    g = each.groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "b"))), lambda x: x["b"]).alias("l"))
    return g.select("p_size", F.array_join(R.distinct_ignoring_case(F.col("l")), ",").alias("brands"))


@query("""select l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(list_distinct_in_order, lambda t: not contains(src, t)), ',') as missing from (
select l_orderkey, l_linenumber, l_partkey, l_partkey::varchar || ' of ' || l_suppkey::varchar as src, case when (l_partkey % 100)::varchar = (l_suppkey % 100)::varchar then [(l_partkey % 100)::varchar] else [(l_partkey % 100)::varchar, (l_suppkey % 100)::varchar] end as list_distinct_in_order from lineitem)""")
def ungrounded_numbers(spark, sf_dir):
    made = F.concat(F.lit("The vote was "), (F.col("l_partkey") % 100).cast("string"), F.lit(" to "), (F.col("l_suppkey") % 100).cast("string"), F.lit("."))
    source = F.concat(F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))
    return T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(R.ungrounded(made, source), ",").alias("missing"))


@query("""select event_id, coalesce((props->>'k')::bigint, 0) as k, (props->>'k')::bigint is null as absent, case when (props->>'k')::bigint >= 5 then '{"event_id":' || event_id::varchar || ',"k":' || (props->>'k') || '}' else '{"event_id":' || event_id::varchar || '}' end as sparse from events""")
def document_codec(spark, sf_dir):
    """Documents read with defaults for absent fields, and written without null ones."""
    e = T(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long, extra string").alias("d"))
    k = F.col("d.k")
    return e.select("event_id", F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("absent"), F.to_json(F.struct("event_id", F.when(k >= 5, k).alias("k"))).alias("sparse"))


@query("""with o as (select o_orderkey, cast(o_orderdate as date) as day, o_orderpriority as title from orders)
select o_orderkey, strftime(day, '%Y-%m-%d') as iso, title from o where day between date '1995-01-01' and date '1996-06-30' and not starts_with(lower(trim(title)), '5')""")
def nested_calendar(spark, sf_dir):
    """A calendar as nested maps of days and times, written out and flattened again."""
    o = T(spark, sf_dir, "orders").where("year(o_orderdate) between 1995 and 1996")
    leaf = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "HH:mm").alias("hour")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))).alias("ms"))
    doc = leaf.groupBy(F.substring("day", 1, 7).alias("month")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("day", F.create_map("hour", "ms"))))).alias("json"))
    read = doc.select(F.explode(F.from_json("json", "map<string,map<string,array<struct<id:bigint,title:string>>>>")).alias("day", "hours")).select("day", F.explode("hours").alias("hour", "ms")).select("day", F.explode("ms").alias("m"))
    kept = read.where("day between '1995-01-01' and '1996-06-30' and not startswith(lower(trim(m.title)), '5')")
    return kept.select(F.col("m.id").alias("o_orderkey"), F.col("day").alias("iso"), F.col("m.title").alias("title"))


@query("""with d as (select user_id, event_type, min(event_id) as first from events group by 1, 2)
select user_id, event_type, (dense_rank() over (partition by user_id order by first) - 1) % 3 as hue from d""")
def topic_hues(spark, sf_dir):
    d = T(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return d.select("user_id", "event_type", ((F.dense_rank().over(Window.partitionBy("user_id").orderBy("first")) - 1) % 3).cast("long").alias("hue"))


@query("""select o_orderkey, o_custkey, o_totalprice = max(o_totalprice) over (partition by o_custkey) and o_orderkey = min(o_orderkey) over (partition by o_custkey, o_totalprice) as starred from orders""")
def one_starred(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(w) == 1).alias("starred"))


@query(f"""with {TURNS}, s as (select meeting, label, count(*) as n, sum(greatest(0.0, end_time - start_time)) as seconds, arg_max(segment_id, (end_time - start_time, -segment_id)) as longest from turns group by 1, 2)
select meeting, label, n, round(seconds, 3) as seconds, longest, row_number() over (partition by meeting order by seconds desc, label) as place from s""")
def review_state(spark, sf_dir):
    """Per label: turns, speech, its longest turn, and the order in which to review."""
    length = F.col("end_time") - F.col("start_time")
    s = V.turns(spark, sf_dir).groupBy("meeting", "label").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.0), length)).alias("s"), F.max_by("segment_id", F.struct(length.alias("l"), (-F.col("segment_id")).alias("i"))).alias("longest"))
    w = Window.partitionBy("meeting").orderBy(F.desc("s"), "label")
    return s.select("meeting", "label", "n", F.round("s", 3).alias("seconds"), "longest", F.row_number().over(w).cast("long").alias("place"))


@query(f"""with {TURNS}, s as (select meeting, label, sum(end_time - start_time) as seconds from turns group by 1, 2)
select meeting, round(min(seconds), 3) as least, round(max(seconds), 3) as most, round(quantile_cont(seconds, 0.75), 3) as p75, round(quantile_cont(seconds, 0.5), 3) as middle from s group by 1""")
def speech_spread(spark, sf_dir):
    s = V.turns(spark, sf_dir).groupBy("meeting", "label").agg(F.sum(F.col("end_time") - F.col("start_time")).alias("s"))
    return s.groupBy("meeting").agg(F.round(F.min("s"), 3).alias("least"), F.round(F.max("s"), 3).alias("most"), F.round(F.percentile("s", 0.75), 3).alias("p75"), F.round(F.percentile("s", 0.5), 3).alias("middle"))


@query("""with n as (select max(o_orderkey) as n from orders), m as (select distinct l_orderkey % (n // 2 + 1) as ref, l_orderkey as memo from lineitem, n), a as (select o_orderkey % (n // 2 + 9) as ref, o_orderkey as item from orders, n),
mc as (select *, count(*) over (partition by ref) as mn from m), ac as (select *, count(*) over (partition by ref) as an from a)
select memo, item from mc join ac on mc.ref = ac.ref where mn = 1 and an = 1
union all select memo, null from mc where mn > 1 or not exists (select 1 from ac where ac.ref = mc.ref and an = 1)""")
def reconcile_plan(spark, sf_dir):
    """Minutes joined to agenda items by reference where that is unique on both sides; the rest stays unmatched."""
    o = T(spark, sf_dir, "orders")
    n = F.broadcast(o.agg(F.floor(F.max("o_orderkey") / 2).alias("half")))  # one row
    m = T(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(n).select((F.col("l_orderkey") % (F.col("half") + 1)).alias("ref"), F.col("l_orderkey").alias("memo"))
    a = o.join(n).select((F.col("o_orderkey") % (F.col("half") + 9)).alias("ref"), F.col("o_orderkey").alias("item"))
    one = lambda df, c: df.groupBy("ref").agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").select("ref", c)
    pairs = one(m, "memo").join(one(a, "item"), "ref").select("memo", "item")
    return m.join(pairs, "memo", "left").select("memo", "item")


@query(f"""with {TURNS}, {SECTIONS}, x as (select s.meeting, section_id, topic, label, segment_id from turns t join sections s on t.meeting = s.meeting and section_start <= start_time and start_time < section_end)
select meeting, topic, count(distinct section_id) as n_sections, count(distinct label) as n_speakers, count(*) as n_turns from x group by 1, 2""")
def section_topics(spark, sf_dir):
    sections = V.sections(spark, sf_dir).withColumn("section", F.struct("section_id", "topic"))
    x = I.labels_inside(V.turns(spark, sf_dir), sections, "meeting", "section", "start_time", "section_start", "section_end")
    return x.groupBy("meeting", F.col("section.topic").alias("topic")).agg(F.count_distinct("section.section_id").alias("n_sections"), F.count_distinct("label").alias("n_speakers"), F.sum("n").alias("n_turns"))


@query("""with g as (select t / 10.0 as threshold, doc_id, quality, n_chars from (select unnest(range(1, 10)) as t) cross join labels join documents using (doc_id)),
s as (select threshold, avg((((n_chars % 100) / 100.0 >= threshold) = (quality = 1))::int) as accuracy, avg(((n_chars % 100) / 100.0 >= threshold)::int) as kept from g group by 1)
select round(threshold, 1) as threshold, round(accuracy, 5) as accuracy, kept >= 0.3 as passes, row_number() over (order by kept >= 0.3 desc, round(accuracy, 9) desc, threshold) as place from s""")
def threshold_grid(spark, sf_dir):
    """A grid of thresholds, each scored on all labelled rows; those that keep enough come first, best first."""
    r = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    g = r.withColumn("threshold", F.explode(F.array(*[F.lit(t / 10.0) for t in range(1, 10)])))
    said = (F.col("n_chars") % 100) / 100.0 >= F.col("threshold")
    s = g.groupBy("threshold").agg(F.avg((said == (F.col("quality") == 1)).cast("int")).alias("a"), F.avg(said.cast("int")).alias("k"))
    w = Window.orderBy(F.desc(F.col("k") >= 0.3), F.desc(F.round("a", 9)), "threshold")  # nine rows
    return s.select(F.round("threshold", 1).alias("threshold"), F.round("a", 5).alias("accuracy"), (F.col("k") >= 0.3).alias("passes"), F.row_number().over(w).cast("long").alias("place"))

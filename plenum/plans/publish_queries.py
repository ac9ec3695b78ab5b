"""Publishing several tables together and items aligned to segments, over all events and orders; each with its DuckDB statement."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions.graph import scratch_dir
from plenum.operators import publish as P
from plenum.plans import views as V
from plenum.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query("""with e as (select event_id, user_id as meeting, 'S' || (event_id % 5) as label, value from events),
sp as (select distinct meeting, label, case when meeting % 8 = 0 and label in ('S1', 'S3') then ['Ann ', 'ann'][(label = 'S3')::int + 1] else 'N' || label end as name from e),
ok as (select distinct meeting from e where meeting % 2 = 0 and meeting not in (select meeting from sp where label <> 'S4' group by meeting, lower(trim(name)) having count(distinct label) > 1)),
g as (select meeting, event_id from e where meeting in (from ok) and event_id % 3 > 0 and meeting % 10 > 0 union all select meeting, event_id from e where meeting not in (from ok) and event_id % 2 = 0),
s as (select meeting, label, name from sp where meeting in (from ok) union all select meeting, label, 'old' from sp where meeting not in (from ok) and label < 'S2'),
m as (select meeting, 'new' as title, (select count(*) from g where g.meeting = ok.meeting) as n_segments, (select count(*) from s where s.meeting = ok.meeting) as n_speakers from ok
  union all select distinct meeting, 'old', 0, 0 from e where meeting % 3 > 0 and meeting not in (from ok))
select 'meetings' as part, meeting, count(*) as n, sum(n_segments * 100 + n_speakers)::bigint as total, max(title) as told from m group by all
union all select 'segments', meeting, count(*), sum(event_id)::bigint, '' from g group by all
union all select 'speakers', meeting, count(*), sum(length(name))::bigint, max(name) from s group by all""")
def published_tables(spark, sf_dir):
    """Even users' meetings published over older tables, written together and read back."""
    e = V.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("meeting"), F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string")).alias("label"))
    twice = (F.col("meeting") % 8 == 0) & F.col("label").isin("S1", "S3")
    people = e.select("meeting", "label").distinct().withColumn("name", F.when(twice, F.when(F.col("label") == "S1", "Ann ").otherwise("ann")).otherwise(F.concat(F.lit("N"), "label")))
    known = e.select("meeting").distinct()
    zero = F.lit(0).cast("long")
    stored = {
        "meetings": known.where("meeting % 3 > 0").select("meeting", F.lit("old").alias("title"), zero.alias("n_segments"), zero.alias("n_speakers")),
        "segments": e.where("event_id % 2 = 0").select("meeting", "event_id"),
        "speakers": people.where("label < 'S2'").select("meeting", "label", F.lit("old").alias("name")),
    }
    board = P.Board(spark, f"{scratch_dir(spark).rstrip('/')}/board-{uuid.uuid4().hex}")
    board.put("before", stored)
    meetings = known.where("meeting % 2 = 0").select("meeting", F.lit("new").alias("title"))
    segments = e.where("meeting % 2 = 0 and event_id % 3 > 0 and meeting % 10 > 0").select("meeting", "event_id")
    board.put("even", P.publish(board.tables(), meetings, segments, people.where("meeting % 2 = 0"), F.col("label") == "S4"))
    t = board.tables()
    fold = lambda name, total, told: t[name].groupBy("meeting").agg(F.count("*").alias("n"), F.sum(total).cast("long").alias("total"), F.max(told).alias("told")).select(F.lit(name).alias("part"), "*")
    out = fold("meetings", F.col("n_segments") * 100 + F.col("n_speakers"), F.col("title"))
    return out.unionByName(fold("segments", F.col("event_id"), F.lit(""))).unionByName(fold("speakers", F.length("name"), F.col("name")))


@query("""with s as (select o_custkey as meeting, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as place, o_totalprice as t from orders),
u as (select meeting, o_orderkey as position, case when o_orderkey % 5 > 0 then place end as first, case when o_orderkey % 7 > 0 then place + 1 end as last, case when o_orderkey % 2 = 0 then 'passed' end as outcome from s where o_orderkey % 3 > 0)
select x.meeting, x.o_orderkey as position, case when u.position is not null then 'happened' else 'upcoming' end as status, case when first is not null and last is not null then a.t end as start,
  case when first is not null and last is not null then b.t + 1 end as "end", coalesce(case when x.o_orderkey % 4 = 0 then 'failed' end, outcome) as outcome
from s x left join u on u.position = x.o_orderkey left join s a on a.meeting = u.meeting and a.place = u.first left join s b on b.meeting = u.meeting and b.place = u.last""")
def aligned_items(spark, sf_dir):
    k, meeting = F.col("o_orderkey"), F.col("o_custkey").alias("meeting")
    o = V.table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    segments = o.select(meeting, "place", F.col("o_totalprice").alias("start_time"), (F.col("o_totalprice") + 1).alias("end_time"))
    spans = o.where("o_orderkey % 3 > 0").select(meeting, k.alias("position"), F.when(k % 5 > 0, F.col("place")).alias("first"), F.when(k % 7 > 0, F.col("place") + 1).alias("last"), F.when(k % 2 == 0, "passed").alias("outcome"))
    none = F.lit(None).cast("double")
    items = o.select(meeting, k.alias("position"), F.lit("upcoming").alias("status"), none.alias("start"), none.alias("end"), F.when(k % 4 == 0, "failed").alias("outcome"))
    return P.flip_items(items, P.alignment_updates(spans, segments))

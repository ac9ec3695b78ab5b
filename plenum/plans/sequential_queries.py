"""Queries over order-dependent operators. SQL has no form for most of them; tests hold those against plain restatements."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions.text import content_words
from plenum.operators import sequential as Q
from plenum.operators import sessions as S
from plenum.plans import views as V
from plenum.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query(None)
def diarization_error(spark, sf_dir):
    """Turns against a copy in which every seventh turn has another's label and every fifth is shorter."""
    t = V.turns(spark, sf_dir)
    other = F.when(F.col("segment_id") % 7 == 0, F.lit("S00")).otherwise(F.concat(F.lit("H"), F.col("label")))
    short = F.when(F.col("segment_id") % 5 == 0, F.col("end_time") - (F.col("end_time") - F.col("start_time")) / 2).otherwise(F.col("end_time"))
    return Q.diarization_error(t, t.withColumn("end_time", short).withColumn("label", other))


@query(None)
def chunk_stitch(spark, sf_dir):
    """Overlapping windows of a meeting, each with labels of its own, made one again."""
    t = V.turns(spark, sf_dir)
    begin = t.groupBy("meeting").agg(F.floor(F.min("start_time")).cast("double").alias("begin"), (F.ceil(F.max("end_time")) - F.floor(F.min("start_time"))).cast("double").alias("duration"))
    w = S.sliding_windows(begin, 20000.0, 4000.0)
    rel = t.join(begin, "meeting").withColumn("start_time", F.col("start_time") - F.col("begin")).withColumn("end_time", F.col("end_time") - F.col("begin"))
    held = rel.join(w, "meeting").where("start_time >= window_start and start_time < window_end")
    local = F.concat(F.lit("L"), F.pmod(F.substring("label", 2, 2).cast("int") + F.col("window") * 5, F.lit(12)).cast("string"))
    return Q.stitch(held.select("meeting", "window", "owned_from", "owned_to", local.alias("local"), "start_time", "end_time", F.lit(None).cast("array<double>").alias("voice")))


@query(None)
def record_align(spark, sf_dir):
    """Each conversation's user turns aligned with its assistant turns by shared content words."""
    c = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ordinal"), "role", content_words(F.col("text"), []).alias("words"))
    return Q.align(c.where("role = 'user'").drop("role"), c.where("role = 'assistant'").drop("role"))


@query("""with recursive x as (select l_suppkey, list({'y': l_quantity::int, 'n': (l_partkey % 10)::int} order by l_orderkey, l_linenumber, l_quantity::int, (l_partkey % 10)::int) filter (l_linenumber % 2 = 1) as rolls,
  list({'y': l_quantity::int, 'n': (l_partkey % 10)::int} order by l_orderkey, l_linenumber, l_quantity::int, (l_partkey % 10)::int) filter (l_linenumber % 2 = 0) as said from lineitem group by 1),
m as (select l_suppkey, 0::bigint as k, 0::bigint as last, null::bigint as place from x
  union all select l_suppkey, k, coalesce(p, last), p from (select m.l_suppkey, m.k + 1 as k, m.last,
    list_min(list_filter(range(m.last + 1, len(coalesce(x.said, [])) + 1), lambda j: abs(x.said[j].y - x.rolls[m.k + 1].y) + abs(x.said[j].n - x.rolls[m.k + 1].n) <= 3)) as p
    from m join x using (l_suppkey) where m.k < len(x.rolls)))
select l_suppkey, k - 1 as roll, place from m where k > 0""")
def roll_match(spark, sf_dir):
    """A supplier's odd lines as roll calls, matched in order with its even lines as announcements of near counts."""
    row = F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("yeas"), (F.col("l_partkey") % 10).cast("int").alias("nays"))
    odd = F.col("l_linenumber") % 2 == 1
    g = V.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.when(odd, row))).alias("rolls"), F.array_sort(F.collect_list(F.when(~odd, row))).alias("said"))
    places = Q.match_in_order(F.col("rolls"), F.col("said"), 3)
    return g.select("l_suppkey", F.posexplode(places).alias("roll", "place")).select("l_suppkey", F.col("roll").cast("long").alias("roll"), F.col("place").cast("long").alias("place"))


@query("""with recursive x as (select l_orderkey, list({'f': l_partkey % 60 - 2, 'l': l_partkey % 60 + l_suppkey % 5 - 3} order by l_linenumber, l_partkey, l_suppkey % 5) as spans from lineitem group by 1),
m as (select l_orderkey, 0::bigint as k, (-1)::bigint as bar, null::varchar as refused from x
  union all select l_orderkey, k, case when why is null then f else bar end, why from (select m.l_orderkey, m.k + 1 as k, m.bar, x.spans[m.k + 1].f as f,
    case when x.spans[m.k + 1].f < 0 or x.spans[m.k + 1].l >= 55 then 'range' when x.spans[m.k + 1].l < x.spans[m.k + 1].f then 'order' when x.spans[m.k + 1].f < m.bar then 'backwards' end as why
    from m join x using (l_orderkey) where m.k < len(x.spans)))
select l_orderkey, k - 1 as position, refused from m where k > 0""")
def validate_spans(spark, sf_dir):
    """Proposed spans of an order's lines through the ordered gate."""
    li = V.table(spark, sf_dir, "lineitem")
    s = F.struct("l_linenumber", "l_partkey", (F.col("l_partkey") % 60 - 2).alias("first"), (F.col("l_partkey") % 60 + F.col("l_suppkey") % 5 - 3).alias("last"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(s)).alias("spans"))
    return g.select("l_orderkey", F.posexplode(Q.accept_spans(F.col("spans"), F.lit(55))).alias("position", "refused")).withColumn("position", F.col("position").cast("long"))

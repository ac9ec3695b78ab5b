"""Bounded replays of streams over the events table; the final state is compared with a statement over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plenum.functions.graph import settle
from plenum.plans.registry import registry
from plenum.streaming import polls

QUERIES, ORACLES, query = registry()


def _stream(spark, sf_dir):
    """The events as a stream of one file; a copy in the shared folder, since a stream reads folders."""
    folder = settle(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    path = folder.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(folder.schema).parquet(path), path.rsplit("/", 1)[0]


def _run(df, base, mode="append"):
    out, state = f"{base}/out-{uuid.uuid4().hex}", f"{base}/state-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


@query("select user_id, count(*) as n from (select distinct user_id from events) group by 1")
def stream_dedupe(spark, sf_dir):
    stream, base = _stream(spark, sf_dir)
    return _run(polls.first_seen(stream.select("user_id", "ts"), "user_id", "ts", "60 days"), base).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def stream_upsert(spark, sf_dir):
    stream, base = _stream(spark, sf_dir)
    sink = polls.UpsertSink(f"{base}/latest-{uuid.uuid4().hex}", ["user_id"], ["ts", "event_id"])
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(sink.newest(spark)).select("user_id", "event_id", "event_type")


@query("""with m as (select user_id, event_type as m, lag(event_type) over (partition by user_id order by ts, event_type) as was from events)
select user_id::varchar as key, coalesce(was, '') as old, m as new, count(*) as n from m where m is distinct from was group by all""")
def marker_changes(spark, sf_dir):
    """How often each user's kind of event changes from what to what."""
    stream, base = _stream(spark, sf_dir)
    done = _run(polls.marker_changes(stream, "user_id", "event_type", "ts"), base)
    return done.groupBy("key", F.coalesce("old", F.lit("")).alias("old"), "new").agg(F.count("*").alias("n"))

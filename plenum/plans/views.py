"""Meetings, turns and reference tables recast from the star schema, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("meeting"),
        F.col("event_id").alias("segment_id"),
        F.concat(F.lit("S"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("label"),
        start.alias("start_time"),
        (start + F.col("value")).alias("end_time"),
        F.col("event_type").alias("id_method"),
    )


TURNS = """turns as (
  select cast(ts as date) as meeting, event_id as segment_id, 'S' || lpad(cast(user_id % 12 as varchar), 2, '0') as label,
    epoch_us(ts) / 1e6 as start_time, epoch_us(ts) / 1e6 + value as end_time, event_type as id_method
  from events)"""


METHODS = [
    "human_review", "voice_profile", "voice_profile (returning_2)", "roll_call", "llm", "name_addressing", "title_context", "voice_profile (far)",
    "record", None, "human_confirmed", "chair_recognition",
]
KINDS = ["council", "debate", "community_meeting", "unheard of"]


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who each label of a meeting is: a method by label and day; every eleventh has no name, every thirteenth is no speaker."""
    x = F.substring("label", 2, 2).cast("int") + F.day("meeting")
    method = F.get(F.array(*[F.lit(m) for m in METHODS]), x % 12)
    return turns(spark, sf_dir).select("meeting", "label").distinct().select(
        "meeting", "label", F.when(x % 11 > 0, F.concat(F.lit("N"), "label")).alias("name"), method.alias("id_method"), F.when(x % 13 == 0, "non_speaker").alias("status")
    )


_METHODS = ", ".join("null" if m is None else f"'{m}'" for m in METHODS)
SPEAKERS = f"""speakers as (
  select meeting, label, case when x % 11 > 0 then 'N' || label end as name, [{_METHODS}][x % 12 + 1] as id_method, case when x % 13 = 0 then 'non_speaker' end as status
  from (select distinct meeting, label, substr(label, 2, 2)::int + day(meeting) as x from turns))"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.day("meeting") % 4)
    return turns(spark, sf_dir).select("meeting").distinct().select("meeting", kind.alias("event_kind"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words: clicks, 0.4 s long."""
    return (
        turns(spark, sf_dir)
        .where("id_method = 'click'")
        .select("meeting", F.col("segment_id").alias("word_id"), F.col("start_time").alias("word_start"), (F.col("start_time") + 0.4).alias("word_end"))
    )


WORDS = """words as (
  select meeting, segment_id as word_id, start_time as word_start, start_time + 0.4 as word_end from turns where id_method = 'click')"""


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that words may fall into: all but the clicks."""
    return turns(spark, sf_dir).where("id_method <> 'click'")


SPOKEN = "spoken as (select * from turns where id_method <> 'click')"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a meeting's time line: purchases, each a quarter of an hour long, with a topic."""
    t = turns(spark, sf_dir).where("id_method = 'purchase'")
    return t.select(
        "meeting",
        F.col("segment_id").alias("section_id"),
        F.floor("start_time").cast("double").alias("section_start"),
        (F.floor("start_time") + 900).cast("double").alias("section_end"),
        F.concat(F.lit("topic-"), (F.col("segment_id") % 5).cast("string")).alias("topic"),
    )


SECTIONS = """sections as (
  select meeting, segment_id as section_id, floor(start_time) as section_start, floor(start_time) + 900 as section_end,
    'topic-' || cast(segment_id % 5 as varchar) as topic from turns where id_method = 'purchase')"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice vectors: profile, meeting, vec_id, vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("profile"), (F.col("vec_id") % 20).cast("int").alias("meeting"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )


VECTORS = "vectors as (select label as profile, cast(vec_id % 20 as integer) as meeting, vec_id, cast(embedding as double[]) as vector from embeddings)"

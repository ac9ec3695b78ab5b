"""The quality gate: how much of a meeting's speech is attributed by trusted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Methods of identification by trust, what the verdicts need by kind of event, the speech seconds below which a label
# doesn't count unless all are below, and what probable attribution counts for.
TRUSTED = ["human_review", "human_confirmed", "voice_profile", "roll_call", "self_identification", "chair_recognition"]
UNVERIFIED = ["llm", "name_addressing", "title_context"]
THRESHOLDS = {
    "default": (0.90, 0.50), "council": (0.90, 0.50), "school_board": (0.90, 0.50), "debate": (0.95, 0.60), "forum": (0.90, 0.55),
    "community_meeting": (0.70, 0.40), "floor": (0.70, 0.40), "news_clip": (0.90, 0.50), "press_conference": (0.90, 0.50),
    "podcast": (0.90, 0.50), "other": (0.90, 0.50),
}
FLOOR = 60.0
DISCOUNT = 0.5
TIERS = ["trusted", "probable", "unverified", "unknown"]


def tier(method: Column) -> Column:
    """The trust in a method: a voice match of a returning speaker is probable, any other voice match is trusted."""
    voice = method.startswith("voice_profile")
    return (
        F.when(voice & F.contains(method, F.lit("returning_")), "probable")
        .when(voice | method.isin(TRUSTED), "trusted")
        .when(method.isin(UNVERIFIED), "unverified")
        .otherwise("unknown")
    )


def seconds_by_label(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """(meeting, label, tier, status, seconds): speech of each label; negative lengths and nulls count 0. A label without a name is unknown.

    speakers has at most one row for each meeting and label: name, id_method, status.
    """
    length = F.greatest(F.lit(0.0), F.coalesce("end_time", F.lit(0.0)) - F.coalesce("start_time", F.lit(0.0)))
    summed = turns.groupBy("meeting", "label").agg(F.sum(length).alias("seconds"))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    return summed.join(speakers.select("meeting", "label", "name", "id_method", "status"), ["meeting", "label"], "left").select(
        "meeting", "label", F.when(named, tier(F.col("id_method"))).otherwise("unknown").alias("tier"), "status", "seconds"
    )


def evaluate(
    turns: DataFrame, speakers: DataFrame, kinds: DataFrame, thresholds: dict[str, tuple[float, float]] = THRESHOLDS, floor: float = FLOOR, discount: float = DISCOUNT
) -> DataFrame:
    """Per meeting: eligible labels, the coverage of each tier among them, the effective coverage and the verdict (pass, review, failed).

    Eligible are labels of at least `floor` seconds that are no non_speaker; if there are none, all that are no non_speaker. A meeting
    without speech fails. kinds: meeting, event_kind, which picks the thresholds.
    """
    by_label = seconds_by_label(turns, speakers).withColumn("speaks", ~F.col("status").eqNullSafe(F.lit("non_speaker")))
    w = Window.partitionBy("meeting")
    long = F.col("speaks") & (F.col("seconds") >= floor)
    told = by_label.withColumn("any_long", F.max(long).over(w)).withColumn("eligible", F.when(F.col("any_long"), long).otherwise(F.col("speaks")))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("eligible") & (F.col("tier") == t), F.col("seconds"))), F.lit(0.0))
    sums = told.groupBy("meeting").agg(F.sum("seconds").alias("speech"), F.count_if("eligible").alias("n_eligible"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("seconds"))), F.lit(0.0)).alias("base"), *[of(t).alias(t) for t in TIERS])
    share = lambda x: F.when(F.col("base") > 0, x / F.col("base")).otherwise(0.0)
    effective = share(F.col("trusted") + discount * F.col("probable"))
    table = F.create_map(*[x for k, (high, low) in thresholds.items() for x in (F.lit(k), F.struct(F.lit(high).alias("high"), F.lit(low).alias("low")))])
    limits = F.coalesce(F.try_element_at(table, F.coalesce("event_kind", F.lit("default"))), F.element_at(table, F.lit("default")))
    verdict = F.when(F.col("speech") <= 0, "failed").when(effective >= limits["high"], "pass").when(effective >= limits["low"], "review").otherwise("failed")
    return sums.join(kinds, "meeting", "left").select(
        "meeting", "n_eligible", F.round("speech", 3).alias("speech"), *[F.round(share(F.col(t)), 4).alias(f"{t}_coverage") for t in TIERS],
        F.round(effective, 4).alias("effective_coverage"), verdict.alias("verdict"),
    )

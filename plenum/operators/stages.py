"""How far each meeting's work has come, from a log of what was done and taken back; and what a poll has to do again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stages of a meeting's work in order, the first that can be done again, the one a new roster goes back to, and those
# that leave files of their own.
STAGES = ["not_started", "ingested", "diarized", "transcribed", "identified", "summarized", "enrolled", "exported"]
FIRST_AGAIN, RETAG, LEAVES = 2, 3, [2, 3, 4, 5, 7]


def stage_states(log: DataFrame) -> DataFrame:
    """meeting, completed (the stage, 0 where nothing stands), progress, live (stages whose files are there, in order), open (stages still to do).

    log: meeting, seq (order in the meeting, distinct), action, value. Actions: `done` (value: the stage), `rewind` (value: the stage to do
    again; not below the first that can be), `retag` (names are to be found anew), `progress` (value: turns transcribed). A rewind takes back
    the files of its stage and all later ones, and the progress if it reaches transcription; a retag only the files of names. Every
    field is a maximum by order, so rows combine before they move, no meeting is read in one piece, and the same plan is an incremental
    aggregate on a stream, where a rewind that comes late still counts at its place. Rows with a null or unknown action count for nothing.
    """
    seq, action, value = F.col("seq"), F.col("action"), F.col("value").cast("int")
    again = F.greatest(value, F.lit(FIRST_AGAIN))
    at = F.when((action == "done") & value.between(0, len(STAGES) - 1), value).when(action == "rewind", again - 1).when(action == "retag", F.lit(RETAG))
    last = lambda when, x: F.max(F.when(when, F.struct(seq, x)))

    def gone(stage: int) -> Column:
        own = (action == "rewind") & (again <= stage)
        return own | (action == "retag") if stage == RETAG + 1 else own

    parts = [last(at.isNotNull(), at.alias("v")).alias("__at"), last((action == "progress") & value.isNotNull(), value.alias("v")).alias("__progress"), F.max(F.when((action == "rewind") & (again <= RETAG), seq)).alias("__reset")]
    parts += [F.max(F.when((action == "done") & (value == s), seq)).alias(f"__done{s}") for s in LEAVES]
    parts += [F.max(F.when(gone(s), seq)).alias(f"__gone{s}") for s in LEAVES]
    folded = log.groupBy("meeting").agg(*parts)
    stands = lambda when, since: when.isNotNull() & (since.isNull() | (when > since))
    completed = F.coalesce(F.col("__at.v"), F.lit(0))
    live = F.filter(F.array(*[F.when(stands(F.col(f"__done{s}"), F.col(f"__gone{s}")), F.lit(STAGES[s])) for s in LEAVES]), lambda x: x.isNotNull())
    return folded.select(
        "meeting",
        completed.alias("completed"),
        F.when(stands(F.col("__progress.seq"), F.col("__reset")), F.col("__progress.v")).otherwise(0).alias("progress"),
        live.alias("live"),
        F.slice(F.array(*[F.lit(s) for s in STAGES]), completed + 2, F.lit(len(STAGES))).alias("open"),
    )


def poll_plan(listing: DataFrame, state: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """What a poll does for each listed key: wait (nothing posted), skip (the marker is known and its rows are there), heal (known, but its
    rows are missing) or run.

    listing and state: key and marker, one row a key; facts: rows by key, of which only whether there are any matters.
    """
    there = facts.select(F.col(key).alias("key")).distinct().withColumn("there", F.lit(True))
    known = state.select(F.col(key).alias("key"), F.col("marker").alias("known"))
    marker = F.col("row.marker")
    same = F.coalesce(marker == F.col("known"), F.lit(False))
    action = F.when(F.coalesce(marker, F.lit("")) == "", "wait").when(~same, "run").when(F.col("there").isNull(), "heal").otherwise("skip")
    listed = listing.select(F.col(key).alias("key"), F.struct("*").alias("row"))
    return listed.join(known, "key", "left").join(there, "key", "left").select("row.*", action.alias("action"))

"""Sessions, runs and ordered folds over the turns of a meeting. A window holds one meeting's rows, never a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str, out: str = "run") -> DataFrame:
    """Number the maximal runs of equal `key` (1, 2, ...) within `by`; nulls equal each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def merge_adjacent(turns: DataFrame, gap: float, extend: str = "max") -> DataFrame:
    """Turns of one label that follow each other in a meeting within `gap` seconds, merged.

    The distance is from the end of what is merged so far: the largest end with extend="max", the last row's end
    with extend="last". Output: meeting, segment_id (0, 1, ... in a meeting), label, start_time, end_time, n_turns.
    """
    order = [F.col("start_time").asc_nulls_first(), F.col("segment_id").asc_nulls_first()]
    told = runs(turns, ["meeting"], order, "label")
    w = Window.partitionBy("meeting", "run").orderBy(*order)
    reach = F.max("end_time").over(_before(w)) if extend == "max" else F.lag("end_time").over(w)
    flagged = told.withColumn("__cut", F.coalesce((F.col("start_time") - reach < gap).cast("int") == 0, F.lit(True)).cast("int"))
    every = Window.partitionBy("meeting").orderBy(*order)
    island = flagged.withColumn("island", F.sum("__cut").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max("end_time") if extend == "max" else F.max_by("end_time", F.struct("start_time", "segment_id"))
    merged = island.groupBy("meeting", "island").agg(
        F.first("label").alias("label"), F.min("start_time").alias("start_time"), end.alias("end_time"), F.count("*").alias("n_turns")
    )
    return merged.select("meeting", (F.col("island") - 1).cast("long").alias("segment_id"), "label", "start_time", "end_time", "n_turns")


def trim_overlaps(turns: DataFrame) -> DataFrame:
    """A turn that begins before an earlier one ends starts there instead, but not after its own end; rounded to milliseconds."""
    w = Window.partitionBy("meeting").orderBy("start_time", "segment_id")
    reach = F.max("end_time").over(_before(w))
    return turns.withColumn("__reach", reach).withColumn(
        "start_time", F.when(F.col("start_time") < F.col("__reach"), F.floor(F.least("__reach", "end_time") * 1000 + 0.5) / 1000).otherwise(F.col("start_time"))
    ).drop("__reach")


def speaker_runs(turns: DataFrame) -> DataFrame:
    """One row per run of a label: meeting, run, label, first and last segment, bounds, n_turns."""
    told = runs(turns, ["meeting"], ["start_time", "segment_id"], "label")
    at = F.struct("start_time", "segment_id")
    return told.groupBy("meeting", "run").agg(
        F.first("label").alias("label"),
        F.min_by("segment_id", at).alias("first_segment"),
        F.max_by("segment_id", at).alias("last_segment"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.count("*").alias("n_turns"),
    )


def wedged_turns(turns: DataFrame, dur_max: float = 0.7, gap_max: float = 1.0) -> DataFrame:
    """Short turns between two turns of one other label, both close: segment_id, label, around."""
    w = Window.partitionBy("meeting").orderBy("start_time", "segment_id")
    near = turns.select(
        "*",
        F.lag("label").over(w).alias("before"),
        F.lead("label").over(w).alias("around"),
        F.lag("end_time").over(w).alias("before_end"),
        F.lead("start_time").over(w).alias("next_start"),
    )
    return near.where(
        (F.col("before") == F.col("around"))
        & (F.col("label") != F.col("around"))
        & (F.col("end_time") - F.col("start_time") < dur_max)
        & (F.col("start_time") - F.col("before_end") <= gap_max)
        & (F.col("next_start") - F.col("end_time") <= gap_max)
    ).select("meeting", "segment_id", "label", "around")


def next_speaker(turns: DataFrame, within: int = 4) -> DataFrame:
    """Each turn with the first other label among the `within` turns after it (null if none)."""
    w = Window.partitionBy("meeting").orderBy("start_time", "segment_id")
    later = [F.lead("label", k).over(w) for k in range(1, within + 1)]
    return turns.select("meeting", "segment_id", "label", F.coalesce(*[F.when(x != F.col("label"), x) for x in later]).alias("next_label"))


def tumbling_windows(lengths: DataFrame, size: float, least: float = 0.5) -> DataFrame:
    """Windows of `size` seconds over each row's `duration`; a last one shorter than least * size joins the one before.

    Output: meeting, window (0, 1, ...), window_start, window_end. No window for a duration that is null or not positive.
    """
    n = F.ceil(F.col("duration") / size)
    stub = F.col("duration") - (n - 1) * size
    count = F.when((n > 1) & (stub < least * size), n - 1).otherwise(n)
    return (
        lengths.where("duration > 0")
        .withColumn("n", count.cast("int"))
        .select("meeting", "duration", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("window"))
        .select(
            "meeting",
            F.col("window").cast("long").alias("window"),
            (F.col("window") * F.lit(float(size))).alias("window_start"),
            F.when(F.col("window") == F.col("n") - 1, F.col("duration")).otherwise((F.col("window") + 1) * F.lit(float(size))).alias("window_end"),
        )
    )


def sliding_windows(lengths: DataFrame, size: float, overlap: float) -> DataFrame:
    """Windows of `size` seconds that overlap; the first that reaches the end is the last.

    Output as of tumbling_windows, and owned_from, owned_to: a window owns up to the middle of what it shares.
    """
    step = size - overlap
    n = F.greatest(F.ceil((F.col("duration") - size) / step), F.lit(0))
    made = (
        lengths.where("duration > 0")
        .select("meeting", "duration", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("window"))
        .select(
            "meeting",
            F.col("window").cast("long").alias("window"),
            (F.col("window") * F.lit(float(step))).alias("window_start"),
            F.least(F.col("window") * F.lit(float(step)) + size, F.col("duration")).alias("window_end"),
        )
    )
    w = Window.partitionBy("meeting").orderBy("window")
    before, after = F.lag("window_end").over(w), F.lead("window_start").over(w)
    return made.withColumn("owned_from", F.coalesce((before + F.col("window_start")) / 2, "window_start")).withColumn(
        "owned_to", F.coalesce((F.col("window_end") + after) / 2, "window_end")
    )


def with_ends(points: DataFrame, by: str, at: str, length: Column) -> DataFrame:
    """Points as intervals: each ends where the next of its group begins, the last at `length`."""
    w = Window.partitionBy(by).orderBy(at)
    return points.withColumn("until", F.coalesce(F.lead(at).over(w), length))


def normalise_sections(sections: DataFrame) -> DataFrame:
    """Sections in order of their bounds, an end before its start raised to it.

    Needs group, ordinal, start, end. Adds position (1, 2, ...), clamped and moved.
    """
    end = F.greatest("start", "end")
    w = Window.partitionBy("group").orderBy("start", end, "ordinal")
    was = Window.partitionBy("group").orderBy("ordinal")
    return sections.select(
        "group",
        "ordinal",
        "start",
        end.alias("end"),
        F.row_number().over(w).cast("long").alias("position"),
        (F.col("end") < F.col("start")).alias("clamped"),
        (F.row_number().over(w) != F.row_number().over(was)).alias("moved"),
    )

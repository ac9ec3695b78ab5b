"""Scores of predictions, labels and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def confusion(rows: DataFrame, gold: Column, predicted: Column, by: list[str]) -> DataFrame:
    """Counts of outcomes and precision, recall and F1 by group; a null prediction is a failure; null where undefined."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = rows.groupBy(*by).agg(
        count(gold & predicted).alias("tp"), count(~gold & predicted).alias("fp"), count(gold & ~predicted).alias("fn"),
        count(~gold & ~predicted).alias("tn"), F.count_if(predicted.isNull()).alias("failed"), F.count("*").alias("n"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("f1"))


def calibration(rows: DataFrame, predicted: Column, actual: Column, buckets: int = 5) -> DataFrame:
    """Buckets of equal width, 1.0 in the last: n, mean prediction, mean outcome, and the sum of squared errors."""
    b = F.least(F.floor(predicted * buckets), F.lit(buckets - 1)).cast("long")
    return rows.groupBy(b.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(predicted), 4).alias("mean_predicted"),
        F.round(F.avg(actual), 4).alias("mean_actual"),
        F.round(F.sum((predicted - actual) * (predicted - actual)), 4).alias("squared_error"),
    )


def label_positions(sections: DataFrame, group: str) -> DataFrame:
    """Each position of a group with the type of the last section (by ordinal) that covers it; inverted sections don't count."""
    each = sections.where("last >= first").select(group, "ordinal", "type", F.explode(F.sequence("first", "last")).alias("position"))
    return each.groupBy(group, "position").agg(F.max_by("type", "ordinal").alias("type"))


def agreement(gold: DataFrame, other: DataFrame, group: str) -> DataFrame:
    """Positions of gold that other labels the same: n, n_same, share, by group."""
    o = other.select(group, "position", F.col("type").alias("__other"))
    return gold.join(o, [group, "position"], "left").groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col("type") == F.col("__other"), F.lit(False))).alias("n_same")
    ).withColumn("share", F.round(F.col("n_same") / F.col("n"), 4))


def matched_boundaries(gold: Column, candidates: Column, tolerance: int = 1) -> Column:
    """How many of two sorted arrays of positions pair off one to one within tolerance, the first that fits first."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("next"))

    def step(acc: Column, g: Column) -> Column:
        near = F.array_position(F.transform(F.slice(candidates, acc["next"] + 1, F.size(candidates)), lambda c: F.abs(c - g) <= tolerance), True).cast("int")
        return F.struct((acc["hits"] + F.when(near > 0, 1).otherwise(0)).alias("hits"), (acc["next"] + near).alias("next"))

    return F.aggregate(gold, start, step, lambda acc: acc["hits"])

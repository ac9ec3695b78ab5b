"""Keyed writes as functions of tables: the new state from the old one and the changes. A key occurs once in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source replace those of target with the same key, and are added where there is none."""
    return target.join(source, keys, "left_anti").unionByName(source)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """target and the rows of source whose key is new, the first by `order` of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = source.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(target, keys, "left_anti")
    return target.unionByName(new)


def fill_only(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """target with empty values of `columns` (null, or a blank string) filled from the row of source with the same key."""

    def filled(c: str) -> Column:
        own = F.col(c)
        if dict(target.dtypes)[c] == "string":
            own = F.nullif(F.trim(own), F.lit(""))
        return F.coalesce(own, F.col(f"__{c}")).alias(c)

    told = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return target.join(told, keys, "left").select(*[filled(c) if c in columns else F.col(c) for c in target.columns])


def replace_stripe(target: DataFrame, source: DataFrame, stripe: Column, keys: list[str]) -> DataFrame:
    """Rows of target in one writer's stripe, for the keys that source has, give way to source's rows."""
    touched = source.select(*keys).distinct().withColumn("__touched", F.lit(True))
    kept = target.join(touched, keys, "left").where(F.col("__touched").isNull() | ~F.coalesce(stripe, F.lit(False))).drop("__touched")
    return kept.unionByName(source.select(*target.columns))


def update_where(target: DataFrame, source: DataFrame, keys: list[str], column: str, when: Column) -> DataFrame:
    """target with `column` from source where `when`, over both rows (source's column is called new), holds; changed says where."""
    told = source.select(*keys, F.col(column).alias("new"))
    joined = target.join(told, keys, "left").withColumn("changed", F.coalesce(when & F.col("new").isNotNull() & ~F.col(column).eqNullSafe(F.col("new")), F.lit(False)))
    return joined.select(*[F.when(F.col("changed"), F.col("new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in target.columns], "changed")


def delete_cascade(tables: dict[str, DataFrame], key: str, doomed: DataFrame) -> DataFrame:
    """How many rows of each table go and stay when the keys in doomed are deleted: table, deleted, kept."""
    d = doomed.select(key).distinct().withColumn("__d", F.lit(True))
    counts = [
        t.select(key).join(d, key, "left").agg(F.count_if(F.col("__d").isNotNull()).alias("deleted"), F.count_if(F.col("__d").isNull()).alias("kept")).select(F.lit(name).alias("table"), "deleted", "kept")
        for name, t in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def multiset_drift(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """What one bag of rows has more often than the other: the columns, side (missing or extra) and how often.

    Counts by row, joined, so equal rows combine before they move.
    """
    columns = planned.columns
    sides = planned.withColumn("__p", F.lit(1)).unionByName(actual.select(*columns).withColumn("__p", F.lit(-1)))
    net = sides.groupBy(*columns).agg(F.sum("__p").alias("net")).where("net <> 0")
    return net.select(*columns, F.when(F.col("net") > 0, "missing").otherwise("extra").alias("side"), F.abs("net").alias("n"))


def partition_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key of either side, and where it is: both, left or right."""
    a = left.select(key).distinct().withColumn("__a", F.lit(True))
    b = right.select(key).distinct().withColumn("__b", F.lit(True))
    where = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, where.alias("side"))

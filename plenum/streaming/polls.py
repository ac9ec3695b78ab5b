"""Incremental forms: seen-once items, keyed upserts and change markers, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(items: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, whichever of its items comes first; state for a key goes when the watermark has passed it."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, late: str, size: str, slide: str, by: list[str]) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide), *by).agg(F.count("*").alias("n"))


def marker_changes(items: DataFrame, key: str, marker: str, time: str) -> DataFrame:
    """(key, old, new) each time a key's marker differs from the last one; old is null at first. Items of a batch go by time."""

    def changed(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for m in pd.concat(list(parts)).sort_values(["time", "marker"])["marker"]:
            if m is not None and m != last:
                rows.append((k[0], last, m))
                last = m
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["key", "old", "new"], dtype=object)

    told = items.select(F.col(key).cast("string").alias("key"), F.col(marker).cast("string").alias("marker"), F.col(time).cast("timestamp").alias("time"))
    return told.groupBy("key").applyInPandasWithState(changed, "key string, old string, new string", "marker string", "append", GroupStateTimeout.NoTimeout)


class UpsertSink:
    """foreachBatch target: a Parquet table of the latest row by key, written as a new version each batch.

    Versions are folders of the table's path, one per batch id. A batch reads the newest finished version below its own id, so a
    query that starts again from its checkpoint goes on from storage, and a batch that runs again writes the same version.
    """

    def __init__(self, path: str, keys: list[str], order: list[str]):
        self.path, self.keys, self.order = path.rstrip("/"), keys, order

    def newest(self, spark: SparkSession, below: int | None = None) -> str | None:
        """The folder of the newest finished version, with an id below the given one."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not store.exists(folder):
            return None
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        ids = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        done = lambda i: store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={i}/_SUCCESS"))
        return next((f"{self.path}/version={i}" for i in reversed(ids) if (below is None or i < below) and done(i)), None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, version = batch.withColumn("__s", F.lit(1)), self.newest(spark, batch_id)
        if version:
            rows = rows.unionByName(spark.read.parquet(version).withColumn("__s", F.lit(0)))
        latest = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order], F.desc("__s"))
        new = rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__s")
        new.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")

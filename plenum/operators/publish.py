"""Publishing as one plan: what each table becomes, and a write of several tables that all become visible together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators.upsert import upsert


def refused(speakers: DataFrame, placeholder: Column) -> DataFrame:
    """Meetings that can't be published, since labels that are no placeholder share a name: meeting, name, labels (how many).

    Names are compared without outer white space and case; blank names are none.
    """
    name = F.lower(F.trim("name"))
    named = speakers.where(~F.coalesce(placeholder, F.lit(False)) & (F.coalesce(F.trim("name"), F.lit("")) != ""))
    return named.groupBy("meeting", name.alias("name")).agg(F.count_distinct("label").alias("labels")).where("labels > 1")


def alignment_updates(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """What aligned items become: meeting, position, status, start, end, outcome.

    spans: meeting, position, first, last (places of segments, null where none was found), outcome; segments: meeting, place, start_time,
    end_time. Every item has happened; times need both ends. Two equal joins by meeting and place, so a long meeting is no group.
    """
    both = F.col("first").isNotNull() & F.col("last").isNotNull()
    begin = segments.select("meeting", F.col("place").alias("first"), F.col("start_time").alias("__start"))
    close = segments.select("meeting", F.col("place").alias("last"), F.col("end_time").alias("__end"))
    return (
        spans.join(begin, ["meeting", "first"], "left")
        .join(close, ["meeting", "last"], "left")
        .select("meeting", "position", F.lit("happened").alias("status"), F.when(both, F.col("__start")).alias("start"), F.when(both, F.col("__end")).alias("end"), "outcome")
    )


def flip_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    """items (meeting, position, status, start, end, outcome and others) after the updates: status and times are taken over, an outcome only where there is none."""
    told = updates.select("meeting", "position", F.struct("status", "start", "end", "outcome").alias("new"))
    held = items.select("meeting", "position", F.struct("*").alias("item"))
    new = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"item.{c}")) for c in ("status", "start", "end")} | {"outcome": F.coalesce("item.outcome", "new.outcome")}
    return held.join(told, ["meeting", "position"], "left").select(*[new.get(c, F.col("item")[c]).alias(c) for c in items.columns])


def publish(stored: dict[str, DataFrame], meetings: DataFrame, segments: DataFrame, speakers: DataFrame, placeholder: Column) -> dict[str, DataFrame]:
    """The tables meetings, segments and speakers after publishing; meetings that are refused change nothing in any of them.

    A meeting's row is written over with its counts of segments and speakers, its segments and speakers give way to the new ones, also
    where there are none any more. Publishing once more changes nothing.
    """
    fine = meetings.join(refused(speakers, placeholder).select("meeting"), "meeting", "left_anti")
    keys = fine.select("meeting")
    parts = {"segments": segments.join(keys, "meeting", "left_semi"), "speakers": speakers.join(keys, "meeting", "left_semi")}
    counted = fine
    for name, rows in parts.items():
        counted = counted.join(rows.groupBy("meeting").agg(F.count("*").alias(f"n_{name}")), "meeting", "left").fillna(0, [f"n_{name}"])
    out = {"meetings": upsert(stored["meetings"], counted.select(*stored["meetings"].columns), ["meeting"])}
    for name, rows in parts.items():
        kept = stored[name].join(keys, "meeting", "left_anti")
        out[name] = kept.unionByName(rows.select(*stored[name].columns))
    return out


class Board:
    """Tables in a shared folder, each version of which is a list of folders, one a table, that is put in place by one rename.

    Readers see the newest list whole: all tables of a publication or none. A publication has a name; one that is in place is not written
    again, so a job that was lost may run again. What a lost job leaves is in folders that no list names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _lists(self) -> list[str]:
        folder = self._fs.Path(f"{self.path}/lists")
        store = folder.getFileSystem(self._conf)
        return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []

    def _read(self, name: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/lists/{name}").collect()))

    def tables(self) -> dict[str, DataFrame]:
        """The tables as last published; none at first."""
        lists = self._lists()
        return {n: self.spark.read.parquet(f"{self.path}/{p}") for n, p in self._read(lists[-1])["tables"].items()} if lists else {}

    def put(self, publication: str, tables: dict[str, DataFrame]) -> bool:
        """Write new versions of these tables, then show them together; others stay. False where this publication is in place already.

        Fails, and shows nothing, if another publication was put in place since this one began.
        """
        lists = self._lists()
        last = self._read(lists[-1]) if lists else {"tables": {}, "done": []}
        if publication in last["done"]:
            return False
        folder = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/rows/{folder}/{name}")
        text = json.dumps({"tables": last["tables"] | {n: f"rows/{folder}/{n}" for n in tables}, "done": [*last["done"], publication]})
        draft, place = f"{self.path}/rows/{folder}/list", f"{self.path}/lists/{len(lists):012d}"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(draft)
        here = self._fs.Path(f"{self.path}/lists")
        here.getFileSystem(self._conf).mkdirs(here)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        self._fs.FileContext.getFileContext(here.toUri(), self._conf).rename(self._fs.Path(draft), self._fs.Path(place), none)
        return True

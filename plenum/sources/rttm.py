"""RTTM and UEM files: diarized turns and scored regions as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """SPEAKER lines: file, start_time, end_time, label. Other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .select(p.alias("p"))
        .where((F.get("p", 0) == "SPEAKER") & (F.size("p") >= 8))
        .select(
            F.get("p", 1).alias("file"),
            F.get("p", 3).cast("double").alias("start_time"),
            (F.get("p", 3).cast("double") + F.get("p", 4).cast("double")).alias("end_time"),
            F.get("p", 7).alias("label"),
        )
    )


def read_uem(spark: SparkSession, path: str) -> DataFrame:
    """file, start_time, end_time; blank lines and comments are left out, a line of fewer than four fields is an error."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(p.alias("p"), "value")
    fine = F.when(F.size("p") < 4, F.raise_error(F.concat(F.lit("not a UEM line: "), "value"))).otherwise(F.col("p"))
    return lines.select(fine.alias("p")).select(F.get("p", 0).alias("file"), F.get("p", 2).cast("double").alias("start_time"), F.get("p", 3).cast("double").alias("end_time"))


def rttm_line(file: str = "meeting", start: str = "start_time", end: str = "end_time", label: str = "label") -> Column:
    """A turn as a SPEAKER line; times to the millisecond."""

    def ms(x: Column) -> Column:
        n = F.floor(x * 1000 + 0.5).cast("long")
        return F.format_string("%d.%03d", F.floor(n / 1000).cast("long"), n % 1000)

    return F.format_string("SPEAKER %s 1 %s %s <NA> <NA> %s <NA> <NA>", F.col(file).cast("string"), ms(F.col(start)), ms(F.col(end) - F.col(start)), F.col(label))

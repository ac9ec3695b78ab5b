"""Results written to the shared folder, checked broadcasts, and connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Frames that settle() wrote inside the innermost passing().
_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share, spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-plenum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/plenum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    if (noted := _PASSING.get()) is not None:
        noted.append(done)
    return done


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A step of a longer job: what settle() writes inside is deleted at its end, but for frames that were given to the yielded function."""
    noted: list[DataFrame] = []
    kept: set[int] = set()

    def keep(settled: DataFrame) -> DataFrame:
        kept.add(id(settled))
        return settled

    before = _PASSING.set(noted)
    try:
        yield keep
    finally:
        _PASSING.reset(before)
        for done in noted:
            if id(done) not in kept:
                forget(done)


def forget(settled: DataFrame) -> None:
    """Delete what settle() wrote for a frame that nothing reads any more, such as a loop's last round."""
    spark = settled.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("plenum-"):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_enough(df: DataFrame, limit: int) -> bool:
    """True if df has at most limit rows; it reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint if df was counted to have at most limit rows; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(df, limit) else df


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the undirected edges.

    Minimum labels with pointer jumping, so a chain of n nodes takes about log n rounds. Each round is two shuffled joins whose hot
    keys adaptive execution can split, and one aggregation that combines before it shuffles; it ends when no label changes. The
    round's labels are settled, so a lost executor repeats one round at most. Null ends and loops are left out.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    links = settle(pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = settle(links.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component")))
    while True:
        # the least label among the neighbours
        near = (
            links.join(labels, links.x == labels.node)
            .groupBy(F.col("y").alias("n"))
            .agg(F.min("component").alias("seen"))
        )
        lower = labels.join(near, labels.node == near.n, "left").select(
            "node", F.col("component").alias("was"), F.least("component", "seen").alias("c")
        )
        # and then the label of that label
        jump = labels.select(F.col("node").alias("r"), F.col("component").alias("up"))
        nxt = settle(
            lower.join(jump, lower.c == jump.r, "left").select(
                "node", F.least("c", "up").alias("component"), (F.least("c", "up") < F.col("was")).alias("moved")
            )
        )
        forget(labels)
        labels = nxt.select("node", "component")
        if nxt.where("moved").isEmpty():
            return labels


def components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, component): each node's smallest reachable node, itself included, also of nodes without edges."""
    comp = connected_components(edges, a, b).withColumnRenamed("node", "__n")
    n = nodes.select(F.col(node).alias("node")).distinct()
    return n.join(comp, n.node == comp["__n"], "left").select("node", F.coalesce("component", "node").alias("component"))

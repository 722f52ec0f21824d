"""Helpers that several operators use: durable intermediates and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in one process, as in local tests, a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's own setting: a finished query's shuffle files go at once, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run and end in here leave no shuffle files."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def durable_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Like :func:`durable`, as compressed Parquet: for wide or text-heavy rows. Its shuffle files go, and :func:`discard` takes it away."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`durable_table` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less any column whose name (in either case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, stem: str) -> str:
    """A name like ``stem`` that no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def masked(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with all but the needed columns under names that no operator uses; ``toDF`` undoes it."""
    return df.toDF(*[c if c in needed else f"__column{i}" for i, c in enumerate(df.columns)])


#: A node with over one in so many edges is looked up by broadcast: at most twice as many nodes are.
HOT_SHARE = 1000


def _with_least(edge: DataFrame, both: DataFrame, total: int) -> DataFrame:
    """``edge(u, v)`` with ``m``, the least neighbour of ``u`` in ``both``, or ``u`` itself if it is less.

    Rows of a node with more than ``total / HOT_SHARE`` edges stay where they are; those of all others are
    dealt by ``u``, so that no task gets more than this share for one node.
    """
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    is_hot = F.col("n") * HOT_SHARE > total
    hot = least.where(is_hot).select("u", F.col("m").alias("hot_m"))
    marked = edge.join(F.broadcast(hot), "u", "left")
    rest = marked.where("hot_m IS NULL").select("u", "v").join(least.where(~is_hot).select("u", "m"), "u")
    return rest.unionByName(marked.where("hot_m IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges(a long, b long)`` in any order; returns ``(node, root)`` for nodes that are not
    their own root. Alternates large-star and small-star steps: each shrinks paths towards
    the smallest node, group minima combine before the shuffle, and a hub is neither
    collected nor dealt to one task. Every round is checkpointed.
    """
    edge = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        after = edge.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if after == before or after["n"] == 0:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.where("v > u"), both, 2 * after["n"])
        large = durable(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_least(large, large, after["n"])
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        edge = durable(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct())

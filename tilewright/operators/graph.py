"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 60


def ensure_checkpoints(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir; where that is unset, one of this machine, which only a local master can share."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    context.setCheckpointDir(tempfile.mkdtemp())


def saved(df: DataFrame, _name: str = "") -> DataFrame:
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """A table in the shared folder; saving the next one removes the one before, and the driver's end the last."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoints(spark)
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        self.spark, self.path = spark, None
        self.folder = f"{(found.get() if found.isDefined() else spark.conf.get('spark.checkpoint.dir')).rstrip('/')}/table-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.remove()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            if self.path:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, so that Spark removes the shuffle files of finished tables.

    The driver holds on to the last query it has run, so an empty one is run first."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def _minima(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    met = down.join(_minima(down), "u")
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame, save: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id it reaches.

    Minima are aggregated before they are joined back, so an id with very many links costs
    no task more than its share. Every round is saved outside the executors."""
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        edges = save(_small(_large(edges)), "star")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()

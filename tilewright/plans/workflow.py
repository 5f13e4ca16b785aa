"""Cohort state as tables: stage roll-ups, drift between records and stores, run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_collapse(tasks: DataFrame, by: list[str], status: str = "status", order: str = "key") -> DataFrame:
    """One status a stage: error before running before all-completed, else pending; with the first error text."""
    s = F.col(status)
    aggs = [F.count(F.lit(1)).alias("n_tasks"), F.bool_or(s == "error").alias("e"), F.bool_or(s == "running").alias("r"), F.every(s == "completed").alias("c")]
    if "error" in tasks.columns:
        aggs.append(F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("first_error"))
    out = tasks.groupBy(*by).agg(*aggs)
    value = F.when(F.col("e"), "error").when(F.col("r"), "running").when(F.col("c"), "completed").otherwise("pending")
    return out.withColumn("status", value).drop("e", "r", "c")


def cohort_rollup(stages: DataFrame, by: list[str]) -> DataFrame:
    return stages.groupBy(*by).agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("total"))


def missing_outputs(recorded: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded as done, absent from the store."""
    return recorded.join(present.select(*keys).distinct(), keys, "left_anti")


def orphans(present: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """In the store, not recorded."""
    return present.join(recorded.select(*keys).distinct(), keys, "left_anti")


def channel_drift(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Slides whose markers differ from the resolved map at some channel, nulls compared as values."""
    c = current.select("slide_id", "channel_idx", F.col("marker").alias("a"))
    e = expected.select("slide_id", "channel_idx", F.col("marker").alias("b"))
    both = c.join(e, ["slide_id", "channel_idx"], "full")
    return both.groupBy("slide_id").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_drifted")).withColumn("in_sync", F.col("n_drifted") == 0)


def pending_work(wanted: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted work that no completed task with an output covers."""
    return wanted.join(tasks.where("status = 'completed' and output is not null").select(*keys).distinct(), keys, "left_anti")


def latest_runs(runs: DataFrame, by: list[str], started: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(started), F.desc(tie))
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def durations(tasks: DataFrame, started: str = "started_at", completed: str = "completed_at") -> DataFrame:
    """Whole seconds; null unless both times are there."""
    t = lambda c: F.unix_timestamp(F.to_timestamp(c))
    return tasks.withColumn("duration_s", t(completed) - t(started))


def resolve_mpp(slides: DataFrame, table: DataFrame, fallback: float | None = None) -> DataFrame:
    """Microns a pixel: the table's, else the source's, else the fallback; finite and positive, or an error."""
    own = table.select(F.col("image").alias("name"), F.col("mpp").alias("_csv"))
    value = F.coalesce("_csv", "mpp", F.lit(fallback).cast("double"))
    valid = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return slides.join(own, "name", "left").withColumn("mpp", F.when(valid, value).otherwise(F.raise_error(F.concat(F.lit("no valid mpp for "), F.col("name"))).cast("double"))).drop("_csv")


def uniform_mpp(files: DataFrame, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One mpp a directory: null if none is tagged; a mix of tagged and untagged, or a spread, is an error."""
    a = files.groupBy(*by).agg(F.count("mpp").alias("tagged"), F.count(F.lit(1)).alias("n"), F.min("mpp").alias("low"), F.max("mpp").alias("high"))
    bad = F.col("tagged").between(1, F.col("n") - 1) | (F.col("high") - F.col("low") > tolerance)
    return a.select(*by, F.when(bad, F.raise_error(F.lit("files disagree on mpp")).cast("double")).otherwise(F.col("low")).alias("mpp"))

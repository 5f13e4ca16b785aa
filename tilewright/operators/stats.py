"""Marker statistics in two phases: partial counts, means and variances a slide, pooled exactly over a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slide_partials(pixels: DataFrame, value: str = "v", by: tuple[str, ...] = ("slide_id", "marker")) -> DataFrame:
    """n, mean and sample variance; the variance of one pixel is 0."""
    return pixels.groupBy(*by).agg(
        F.count(value).alias("n_pixels"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"),
    )


def pool(partials: DataFrame, by: tuple[str, ...] = ("marker",)) -> DataFrame:
    """Mean and sample deviation of the union, from partials alone; a cohort without pixels is an error."""
    keys = list(by)
    means = partials.groupBy(*keys).agg(F.sum("n_pixels").alias("n"), F.sum(F.col("n_pixels") * F.col("mean")).alias("s"))
    joined = partials.join(means, keys)
    mean = F.col("s") / F.col("n")
    spread = F.sum((F.col("n_pixels") - 1) * F.col("var") * (F.col("n_pixels") > 0).cast("int") + F.col("n_pixels") * F.pow(F.col("mean") - mean, 2))
    pooled = joined.groupBy(*keys, "n", "s").agg(spread.alias("q"))
    checked = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no pixels to pool")).cast("bigint"))
    return pooled.select(*keys, checked.alias("n"), mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.col("q") / (F.col("n") - 1))).otherwise(0.0).alias("std"))


def fill_blank(markers: DataFrame, pooled: DataFrame) -> DataFrame:
    """markers(marker, mean, std, ...): only blank cells take pooled values; what users gave stays."""
    found = pooled.select("marker", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    out = markers.join(found, "marker", "left")
    return out.withColumns({"mean": F.coalesce("mean", "_m"), "std": F.coalesce("std", "_s")}).drop("_m", "_s")


def region_key(runs: DataFrame) -> DataFrame:
    """By slide: a digest of the region itself, so that another region of equal size is another key."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x_start", "x_end")))
    return runs.groupBy("slide_id").agg(F.sha2(F.to_json(rows), 256).alias("region_key"), F.sum(F.col("x_end") - F.col("x_start")).alias("n_pixels"))


def stale_partials(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(slide_id, marker) whose stored partial is missing or was taken over another region."""
    return wanted.join(stored.select("slide_id", "marker", "region_key"), ["slide_id", "marker", "region_key"], "left_anti")

"""The numbers behind figures and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lengths a scale bar may have.
NICE = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)


def patch_counts(patches: DataFrame, by: list[str]) -> DataFrame:
    """Patches, those touching tissue, and the mean share under tissue."""
    return patches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tissue_prop") > 0).alias("touching"), F.avg("tissue_prop").alias("mean_share"))


def evenly_spaced(rows: DataFrame, by: list[str], order: str, most: int = 12) -> DataFrame:
    """At most ``most`` rows a group, spread evenly from the first to the last."""
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(1, most - 1)).cast("int")))
    picked = counts.select(*by, F.explode(places).alias("_i"))
    return numbered.join(picked, [*by, "_i"]).drop("_i")


def nice_length(target: Column) -> Column:
    """The nearest of NICE; the smaller of two equally near."""
    choices = F.array(*(F.struct(F.abs(target - n).alias("d"), F.lit(n).alias("n")) for n in NICE))
    return F.array_min(choices)["n"]


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_map(boxes: DataFrame, scale: int, cluster: str = "cluster") -> DataFrame:
    """Coarse cells with the cluster of the last box over them."""
    cells = boxes.withColumns({"cy": F.floor(F.col("y") / scale), "cx": F.floor(F.col("x") / scale)})
    return cells.groupBy("slide_id", "cy", "cx").agg(F.max_by(cluster, "patch_idx").alias(cluster))


def ordered_union(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct names, each at its first place."""
    return rows.groupBy(name).agg(F.min(order).alias(order))


def same_markers(a: Column, b: Column) -> Column:
    """Whether two panels hold the same markers, in any order."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def uneven_channels(channels: DataFrame) -> DataFrame:
    """Panels by how many slides have them."""
    panels = channels.groupBy("slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel_idx", "marker"))), lambda s: s["marker"]).alias("panel"))
    return panels.groupBy("panel").agg(F.count(F.lit(1)).alias("slides"))

"""Pixel operators on long tables: bounds, stretches, thresholds, projections, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 10_000  # groups whose bounds may be broadcast


def percentile_bounds(pixels: DataFrame, by: list[str], value: str, low: float = 0.01, high: float = 0.99, subsample: int = 1) -> DataFrame:
    """Exact interpolated percentiles, on every ``subsample``-th row and column where that is over 1."""
    own = pixels.where((F.col("y") % subsample == 0) & (F.col("x") % subsample == 0)) if subsample > 1 else pixels
    both = F.percentile(F.col(value), F.array(F.lit(low), F.lit(high)))
    return own.groupBy(*by).agg(both.alias("p")).select(*by, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def stretch(value: Column, lo: Column, hi: Column) -> Column:
    """To [0, 1] between the bounds; all 0 where they coincide."""
    return F.when(hi <= lo, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo))))


def to_byte(share: Column) -> Column:
    return F.floor(share * 255).cast("int")


def otsu_threshold(pixels: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """By group: the bin centre that separates a histogram of ``bins`` bins best; the lowest of equals.

    One aggregate of at most ``bins`` rows a group meets the windows, never the pixels."""
    bounds = pixels.groupBy(*by).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    few = not by or bounds.limit(SMALL + 1).count() <= SMALL
    joined = pixels.join(F.broadcast(bounds) if few else bounds, by) if by else pixels.crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width)))
    histogram = joined.where(F.col(value).isNotNull()).groupBy(*by, "lo", "hi", number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    histogram = histogram.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    weighted = F.col("n") * F.col("bin")
    sums = histogram.withColumns({"n1": F.sum("n").over(up), "s1": F.sum(weighted).over(up), "all_n": F.sum("n").over(whole), "all_s": F.sum(weighted).over(whole)})
    # in bin numbers the variance between classes is a ratio of whole numbers, so the range of the data does not matter
    n1, s1, n, s = (F.col(c).cast("decimal(19,0)") for c in ("n1", "s1", "all_n", "all_s"))
    apart = (s1 * n - s * n1).cast("double")
    between = F.when(F.col("n1") < F.col("all_n"), apart * apart / (n1 * (n - n1)).cast("double")).otherwise(0.0)
    scored = sums.withColumn("between", between)
    return scored.groupBy(*by).agg(F.min_by("centre", F.struct(-F.col("between"), F.col("bin"))).alias("threshold"))


def max_projection(pixels: DataFrame, position: list[str], value: str) -> DataFrame:
    return pixels.groupBy(*position).agg(F.max(value).alias("v"))


def composite_sum(pixels: DataFrame, position: list[str], value: str) -> DataFrame:
    return pixels.groupBy(*position).agg(F.sum(value).alias("v"))


def box_downsample(pixels: DataFrame, factor: int, value: str = "v", by: list[str] | None = None, whole_only: bool = True) -> DataFrame:
    """Truncated means of factor x factor blocks; blocks cut by the border are dropped."""
    keys = [*(by or []), F.floor(F.col("y") / factor).cast("bigint").alias("y"), F.floor(F.col("x") / factor).cast("bigint").alias("x")]
    out = pixels.groupBy(*keys).agg(F.floor(F.avg(value)).cast("bigint").alias("v"), F.count(F.lit(1)).alias("n"))
    return (out.where(F.col("n") == factor * factor) if whole_only else out).drop("n")


def integral_image(pixels: DataFrame, value: str = "v", by: list[str] | None = None) -> DataFrame:
    """Prefix sums over rows, then columns: two windows, each parted by the other coordinate."""
    by = by or []
    across = Window.partitionBy(*by, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("row_sum", F.sum(value).over(across)).withColumn("total", F.sum("row_sum").over(down)).drop("row_sum")


def coverage(runs: DataFrame, slides: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Share of a slide under runs (x_end exclusive), and whether it is plausible."""
    area = runs.groupBy("slide_id").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("n"))
    share = F.coalesce("n", F.lit(0)) / (F.col("height").cast("double") * F.col("width"))
    return slides.join(area, "slide_id", "left").select("slide_id", share.alias("coverage"), share.between(low, high).alias("plausible"))


def check_float_range(pixels: DataFrame, value: str = "v", tolerance: float = 1e-6) -> DataFrame:
    """Channels with values outside [0, 1], or not numbers."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (v < -tolerance) | (v > 1 + tolerance)
    return pixels.groupBy("channel_idx").agg(F.count_if(bad).alias("n_bad"), F.min(value).alias("low"), F.max(value).alias("high")).where("n_bad > 0")


def pseudo_rgb(pixels: DataFrame, colours: DataFrame, value: str = "v") -> DataFrame:
    """Blend channels by colours(channel_idx, r, g, b), divided by how many channels there are."""
    n = pixels.select(F.countDistinct("channel_idx").alias("n_channels"))
    joined = pixels.join(F.broadcast(colours), "channel_idx").crossJoin(F.broadcast(n))
    return joined.groupBy("y", "x").agg(*(F.sum(F.col(value) * F.col(c) / F.col("n_channels")).alias(c) for c in "rgb"))

"""Patch grids, cell boxes, and joins of boxes with points and runs without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_starts(extent: Column, size: int, stride: int) -> Column:
    """0, stride, ... with a last start flush with the border; empty where the extent is below ``size``."""
    last = (extent - F.lit(size)).cast("bigint")
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0).cast("bigint")), F.lit(stride).cast("bigint"))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array_append(steps, last)))


def grid(slides: DataFrame, size: int, stride: int) -> DataFrame:
    """slides(slide_id, height, width) -> (slide_id, patch_idx, x, y), row by row."""
    xs, ys = grid_starts(F.col("width"), size, stride), grid_starts(F.col("height"), size, stride)
    rows = slides.select("slide_id", xs.alias("xs"), F.posexplode(ys).alias("iy", "y"))
    return rows.select("slide_id", "iy", "y", F.size("xs").alias("nx"), F.posexplode("xs").alias("ix", "x")).select("slide_id", (F.col("iy").cast("bigint") * F.col("nx") + F.col("ix")).alias("patch_idx"), "x", "y")


def half_even(value: Column) -> Column:
    return F.rint(value)


def box_origin(centre: Column, size: int) -> Column:
    """Top-left of a box centred on a point; may be negative."""
    return (half_even(centre) - F.lit(size // 2)).cast("bigint")


def box_points(boxes: DataFrame, points: DataFrame, size: int, tile: int | None = None) -> DataFrame:
    """Inner join of boxes (x, y, square of ``size``) with the points (px, py) they contain.

    Both sides go to tiles: a point to one, a box to the few it touches; an equi-join on the
    tile with the exact test behind it. Shared slide_id columns join too."""
    tile = tile or size
    keys = [c for c in ("slide_id",) if c in boxes.columns and c in points.columns]
    span = lambda c: F.sequence(F.floor(F.col(c) / tile).cast("bigint"), F.floor((F.col(c) + size - 1) / tile).cast("bigint"))
    tiled = boxes.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    dealt = points.withColumn("tx", F.floor(F.col("px") / tile).cast("bigint")).withColumn("ty", F.floor(F.col("py") / tile).cast("bigint"))
    inside = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + size) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + size)
    return tiled.join(dealt, [*keys, "tx", "ty"]).where(inside).drop("tx", "ty")


def tissue_fraction(patches: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """Add tissue_prop: the share of each patch under runs (slide_id, y, x_start, x_end).

    Runs meet patches by tile row and column, so the cost follows the tissue's border."""
    tile = size
    touched = lambda a, b: F.sequence(F.floor(a / tile).cast("bigint"), F.floor((b - 1) / tile).cast("bigint"))
    p = patches.withColumn("ty", F.explode(touched(F.col("y"), F.col("y") + size))).withColumn("tx", F.explode(touched(F.col("x"), F.col("x") + size)))
    r = runs.where("x_end > x_start").select("slide_id", F.col("y").alias("ry"), "x_start", "x_end")
    r = r.withColumn("ty", F.floor(F.col("ry") / tile).cast("bigint")).withColumn("tx", F.explode(touched(F.col("x_start"), F.col("x_end"))))
    left = F.greatest("x", "x_start", F.col("tx") * tile)
    right = F.least(F.col("x") + size, F.col("x_end"), (F.col("tx") + 1) * tile)
    joined = p.join(r, ["slide_id", "ty", "tx"]).where((F.col("ry") >= F.col("y")) & (F.col("ry") < F.col("y") + size))
    sums = joined.groupBy("slide_id", "patch_idx").agg(F.sum(F.greatest(F.lit(0), right - left)).alias("n"))
    share = F.coalesce(F.col("n"), F.lit(0)).cast("double") / float(size * size)
    return patches.join(sums, ["slide_id", "patch_idx"], "left").withColumn("tissue_prop", share.cast("float")).drop("n")


def points_on_runs(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points whose rounded place lies on a run: equal row, then the run around it."""
    at = points.withColumn("_y", half_even(F.col("y")).cast("bigint")).withColumn("_x", half_even(F.col("x")).cast("bigint"))
    r = runs.select("slide_id", F.col("y").cast("bigint").alias("_y"), "x_start", "x_end")
    return at.join(r, ["slide_id", "_y"]).where("_x >= x_start and _x < x_end").select(*points.columns).distinct()


def quadrant(x: Column, y: Column, mid_x: Column, mid_y: Column, band: int) -> Column:
    """1 to 4 by side of the middle, 0 within the band."""
    left, right, up, down = x <= mid_x - band, x >= mid_x + band, y <= mid_y - band, y >= mid_y + band
    return F.when(left & up, 1).when(right & up, 2).when(left & down, 3).when(right & down, 4).otherwise(0)

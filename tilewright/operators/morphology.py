"""Mask morphology on run-length rows (slide_id, y, x_start, x_end exclusive)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, saved

TILE = 256
RUNS = ["slide_id", "y", "x_start", "x_end"]


def merge_runs(runs: DataFrame) -> DataFrame:
    """Union of runs: overlapping and touching ones of a row become one."""
    w = Window.partitionBy("slide_id", "y").orderBy("x_start", "x_end")
    own = runs.where("x_end > x_start").select(*RUNS)
    reach = own.withColumn("reach", F.max("x_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    part = reach.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("x_start") > F.col("reach"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("slide_id", "y", "part").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")).select(*RUNS)


def complement(runs: DataFrame, slides: DataFrame) -> DataFrame:
    """Background runs of slides(slide_id, height, width)."""
    rows = slides.select("slide_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    edges = rows.select("slide_id", F.col("y").cast("bigint").alias("y"), F.lit(-1).cast("bigint").alias("x_start"), F.lit(0).cast("bigint").alias("x_end")).unionByName(
        rows.select("slide_id", F.col("y").cast("bigint").alias("y"), F.col("width").cast("bigint").alias("x_start"), (F.col("width") + 1).cast("bigint").alias("x_end"))
    ).unionByName(merge_runs(runs).select("slide_id", *(F.col(c).cast("bigint").alias(c) for c in RUNS[1:])))
    after = F.lead("x_start").over(Window.partitionBy("slide_id", "y").orderBy("x_start"))
    return edges.select("slide_id", "y", F.col("x_end").alias("x_start"), after.alias("x_end")).where("x_end > x_start")


def components(runs: DataFrame, connectivity: int = 4) -> DataFrame:
    """Merged runs with a component number each: neighbours are runs of adjacent rows that overlap
    (4) or also meet at a corner (8). Adjacency is an equi-join on row and tile, so no slide has to
    fit a task."""
    reach = 0 if connectivity == 4 else 1
    merged = runs.withColumn("run", F.xxhash64("slide_id", "y", "x_start"))
    tiled = lambda r, extra: r.withColumn("t", F.explode(F.sequence(F.floor((F.col("x_start") - extra) / TILE), F.floor((F.col("x_end") - 1 + extra) / TILE))))
    upper = tiled(merged, reach).select("slide_id", (F.col("y") + 1).alias("y"), "t", F.col("x_start").alias("a0"), F.col("x_end").alias("a1"), F.col("run").alias("a"))
    lower = tiled(merged, 0).select("slide_id", "y", "t", "x_start", "x_end", F.col("run").alias("b"))
    touch = (F.col("x_start") < F.col("a1") + reach) & (F.col("a0") < F.col("x_end") + reach)
    found = connected_components(upper.join(lower, ["slide_id", "y", "t"]).where(touch).select("a", "b").distinct())
    return merged.join(found.withColumnRenamed("id", "run"), "run", "left").select(*RUNS, F.coalesce("component", "run").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("slide_id", "component").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("area"), F.count(F.lit(1)).alias("n_runs"))


def min_pixels(mpp: float, area_um2: float = 68.0) -> int:
    return max(1, round(area_um2 / mpp**2))


def remove_small(runs: DataFrame, least: int, connectivity: int = 4) -> DataFrame:
    labelled = components(merge_runs(runs), connectivity)
    large = component_sizes(labelled).where(F.col("area") >= least).select("slide_id", "component")
    return labelled.join(large, ["slide_id", "component"], "left_semi").select(*RUNS)


def fill_holes(runs: DataFrame, slides: DataFrame, most: int, connectivity: int = 4) -> DataFrame:
    """Background components of at most ``most`` pixels that stay off the border become foreground."""
    holes = components(complement(runs, slides), connectivity).join(slides.select("slide_id", "height", "width"), "slide_id")
    border = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x_start") == 0) | (F.col("x_end") == F.col("width"))
    small = holes.groupBy("slide_id", "component").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("n"), F.bool_or(border).alias("open")).where(F.col("n") <= most).where("not open")
    filled = holes.join(small, ["slide_id", "component"], "left_semi").select(*RUNS)
    return merge_runs(runs.select("slide_id", *(F.col(c).cast("bigint").alias(c) for c in RUNS[1:])).unionByName(filled))


def dilate(runs: DataFrame, radius: int) -> DataFrame:
    """By a disk: each run, widened by the disk's half width, on each row the disk reaches."""
    parts = []
    for dy in range(-radius, radius + 1):
        dx = math.isqrt(radius * radius - dy * dy)
        parts.append(runs.select("slide_id", (F.col("y") + dy).cast("bigint").alias("y"), (F.col("x_start") - dx).cast("bigint").alias("x_start"), (F.col("x_end") + dx).cast("bigint").alias("x_end")))
    return merge_runs(reduce(DataFrame.unionByName, parts))


def clip(runs: DataFrame, slides: DataFrame) -> DataFrame:
    joined = runs.join(slides.select("slide_id", "height", "width"), "slide_id").where("y >= 0 and y < height")
    return joined.select("slide_id", "y", F.greatest("x_start", F.lit(0)).alias("x_start"), F.least("x_end", "width").alias("x_end")).where("x_end > x_start")


def erode(runs: DataFrame, slides: DataFrame, radius: int) -> DataFrame:
    """The complement of the dilated complement; what lies beyond the border does not erode."""
    return complement(clip(dilate(complement(runs, slides), radius), slides), slides)


def closing(runs: DataFrame, slides: DataFrame, radius: int) -> DataFrame:
    """Dilation then erosion on a frame wide enough that the border stays out of it."""
    wide = slides.select("slide_id", (F.col("height") + 2 * radius).alias("height"), (F.col("width") + 2 * radius).alias("width"))
    moved = runs.select("slide_id", (F.col("y") + radius).alias("y"), (F.col("x_start") + radius).alias("x_start"), (F.col("x_end") + radius).alias("x_end"))
    closed = erode(dilate(moved, radius), wide, radius)
    return clip(closed.select("slide_id", (F.col("y") - radius).alias("y"), (F.col("x_start") - radius).alias("x_start"), (F.col("x_end") - radius).alias("x_end")), slides)


def cleanup(runs: DataFrame, slides: DataFrame, least: int, hole: int, radius: int, connectivity: int = 8) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Small components out, holes filled, gaps closed; with the component sizes after each stage.

    Each stage is saved outside the executors, as the next one reads it more than once."""
    stages = {"raw": saved(merge_runs(runs))}
    stages["min_area"] = saved(remove_small(stages["raw"], least, connectivity))
    stages["hole_fill"] = saved(fill_holes(stages["min_area"], slides, hole))
    stages["closing"] = saved(closing(stages["hole_fill"], slides, radius))
    return stages["closing"], {k: component_sizes(components(merge_runs(v), connectivity)) for k, v in stages.items()}


def convex_hulls(points: DataFrame) -> DataFrame:
    """(slide_id, ring): the convex hull, counter-clockwise. Only each row's outermost points reach the
    chain, so a task sees at most two points a row of a slide."""
    ends = points.groupBy("slide_id", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = ends.select("slide_id", "y", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"))

    def hull(f: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(zip(f["x"], f["y"]))

        def half(seq) -> list:
            out: list = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out

        ring = half(pts)[:-1] + half(reversed(pts))[:-1] if len(pts) > 2 else pts
        return pd.DataFrame({"slide_id": [f["slide_id"].iloc[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    return rows.groupBy("slide_id").applyInPandas(hull, "slide_id string, ring array<struct<x:double,y:double>>")


def rasterize(polygons: DataFrame) -> DataFrame:
    """Runs of polygons(slide_id, rings): pixels whose centre is inside by the even-odd rule, so inner rings are holes."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for slide, rings in zip(f["slide_id"], f["rings"]):
                edges = []
                for ring in rings:
                    pts = [(p["x"], p["y"]) for p in ring]
                    edges += [(a, b) for a, b in zip(pts, pts[1:] + pts[:1]) if a[1] != b[1]]
                if not edges:
                    continue
                low, high = min(min(a[1], b[1]) for a, b in edges), max(max(a[1], b[1]) for a, b in edges)
                for y in range(math.ceil(low - 0.5), math.floor(high - 0.5) + 1):
                    c = y + 0.5
                    xs = sorted(a[0] + (c - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in edges if min(a[1], b[1]) <= c < max(a[1], b[1]))
                    for x0, x1 in zip(xs[::2], xs[1::2]):
                        s, e = math.ceil(x0 - 0.5), math.ceil(x1 - 0.5)
                        if e > s:
                            out.append((slide, y, s, e))
            yield pd.DataFrame(out, columns=RUNS)

    return merge_runs(polygons.select("slide_id", "rings").mapInPandas(scan, "slide_id string, y bigint, x_start bigint, x_end bigint"))


def outlines(labelled: DataFrame) -> DataFrame:
    """Unit border edges of each component, as directed segments with the component on their left: the
    contour of a mask without tracing it, from which rings follow by chaining."""
    cols = ["slide_id", "component"]
    sides = labelled.select(*cols, F.col("x_start").alias("x0"), (F.col("y") + 1).alias("y0"), F.col("x_start").alias("x1"), F.col("y").alias("y1")).unionByName(
        labelled.select(*cols, F.col("x_end").alias("x0"), F.col("y").alias("y0"), F.col("x_end").alias("x1"), (F.col("y") + 1).alias("y1"))
    )
    marks = labelled.select(*cols, "y", F.col("x_start").alias("a"), F.col("x_end").alias("b"))
    cells = marks.select(*cols, "y", F.explode(F.sequence("a", F.col("b") - 1)).alias("x"))
    above, below = cells.select(*cols, (F.col("y") + 1).alias("y"), "x"), cells.select(*cols, (F.col("y") - 1).alias("y"), "x")
    top = cells.join(above, [*cols, "y", "x"], "left_anti").select(*cols, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1).alias("x1"), F.col("y").alias("y1"))
    bottom = cells.join(below, [*cols, "y", "x"], "left_anti").select(*cols, (F.col("x") + 1).alias("x0"), (F.col("y") + 1).alias("y0"), F.col("x").alias("x1"), (F.col("y") + 1).alias("y1"))
    return sides.unionByName(top).unionByName(bottom)


def geometry_hash(polygons: DataFrame) -> DataFrame:
    """By slide: SHA-256 of all rings rounded to whole pixels, in sorted order."""
    rounded = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(F.rint(p["x"]).cast("bigint"), F.rint(p["y"]).cast("bigint"))))
    return polygons.groupBy("slide_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(rounded))), 256).alias("geometry_hash"))

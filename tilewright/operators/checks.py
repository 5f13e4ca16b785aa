"""Joins with a promise behind them, and checks that name what breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import output_stem

SHOWN = 5
TYPES = ("uint8", "uint16", "float16", "float32", "float64")


def must(rows: DataFrame, ok: Column, text: Column) -> DataFrame:
    """The rows, or an error with the text of one that is not ok. The error is raised where rows are read."""
    first = rows.columns[0]
    kind = rows.schema[first].dataType
    return rows.withColumn(first, F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(text).cast(kind)))


def mask_shapes(masks: DataFrame, slides: DataFrame) -> DataFrame:
    """masks(slide_id, height, width, n_dims) that are not flat, or not of their slide's size, or of no slide."""
    s = slides.select("slide_id", F.col("height").alias("_h"), F.col("width").alias("_w"))
    joined = masks.join(s, "slide_id", "left")
    return joined.where(~F.coalesce((F.col("n_dims") == 2) & (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w")), F.lit(False))).drop("_h", "_w")


def mpp_plausible(mpp: Column, low: float = 0.1, high: float = 1.0) -> Column:
    return F.coalesce(mpp.between(low, high), F.lit(False))


def unsupported_types(channels: DataFrame) -> DataFrame:
    """Channels whose pixels no scale is known for."""
    return channels.where(~F.coalesce(F.col("dtype").isin(*TYPES), F.lit(False)))


def offending(rows: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """By group: how many rows offend, and the first few of their names in order."""
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))), 1, SHOWN), lambda s: s["n"])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), listed.alias("shown"))


def fold_rows(folds: DataFrame, patches: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of a fold with their patch; a row without one is an error."""
    found = folds.join(patches.withColumn("_met", F.lit(True)), key, "left")
    return must(found, F.col("_met"), F.concat(F.lit("a fold names a cell without a patch: "), F.col(key).cast("string"))).drop("_met")


def artifact_of(slides: DataFrame, files: DataFrame) -> DataFrame:
    """slides(slide_id, name) with the one of files(file) that has their stem, or null; two of them are an error."""
    stem = F.regexp_replace(output_stem(F.col("file")), r"\.[^./]*$", "")
    grouped = files.withColumn("_stem", stem).groupBy("_stem").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("_n"))
    joined = slides.join(grouped, output_stem(F.col("name")) == F.col("_stem"), "left")
    return must(joined, F.coalesce("_n", F.lit(0)) <= 1, F.concat(F.lit("more than one file for slide "), F.col("name"))).drop("_stem", "_n")


def footprint(pixels: DataFrame, runs: DataFrame, value: str = "v") -> DataFrame:
    """pixels(slide_id, cell_id, y, x, v) of cells' boxes with 0 where a pixel is not of the box's own cell.

    An equi-join on slide, cell and row; the runs of a cell's row do not overlap, so no pixel comes twice."""
    r = runs.select("slide_id", "cell_id", F.col("y").alias("_y"), "x_start", "x_end")
    on = (pixels["slide_id"] == r["slide_id"]) & (pixels["cell_id"] == r["cell_id"]) & (pixels["y"] == r["_y"]) & (pixels["x"] >= r["x_start"]) & (pixels["x"] < r["x_end"])
    joined = pixels.join(r, on, "left").select(*(pixels[c] for c in pixels.columns if c != value), F.when(r["_y"].isNotNull(), pixels[value]).otherwise(F.lit(0).cast(pixels.schema[value].dataType)).alias(value))
    return joined.select(*pixels.columns)


def in_inset(cells: DataFrame, labels: DataFrame, x: float, y: float, size: float, key: str = "cell_id") -> DataFrame:
    """Cells with their centre in a box, and their labels where they have one."""
    inside = cells.where((F.col("x") >= x) & (F.col("x") < x + size) & (F.col("y") >= y) & (F.col("y") < y + size))
    return inside.join(labels.select(key, "label"), key, "left")


def shared_names(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Names that every group has."""
    groups = rows.agg(F.countDistinct(group).alias("_all"))
    per = rows.groupBy(name).agg(F.countDistinct(group).alias("_n"))
    return per.crossJoin(F.broadcast(groups)).where("_n = _all").select(name)  # one row


def abundance(rows: DataFrame, label: str) -> DataFrame:
    """Classes with their count and place, most common first, equal ones by name."""
    from pyspark.sql import Window

    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), label)))  # a row a class


def stage_counts(tasks: DataFrame, stages: tuple[str, ...] = ("ingest", "tissue", "patch", "extract")) -> DataFrame:
    """By slide: completed tasks of the counted stages, and how many it has."""
    own = tasks.where(F.col("stage").isin(*stages))
    return own.groupBy("slide_id").agg(F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("total"))


def cohort_result(results: DataFrame) -> DataFrame:
    """One row: slides processed, skipped and failed."""
    s = F.col("status")
    return results.agg(F.count_if(s == "completed").alias("processed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("failed"))


def tissue_method(present: DataFrame, requested: str | None = None, default: str = "otsu") -> DataFrame:
    """By slide, of present(slide_id, method): the only method, else the requested, else the default; none of them is an error."""
    have = present.groupBy("slide_id").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    wanted = F.lit(requested if requested is not None else default)
    chosen = F.when(F.size("methods") == 1, F.col("methods")[0]).when(F.array_contains("methods", wanted), wanted)
    problem = F.concat(F.lit("no such tissue method on slide "), F.col("slide_id").cast("string"), F.lit("; it has "), F.array_join("methods", ", "))
    return have.select("slide_id", F.coalesce(chosen, F.raise_error(problem).cast("string")).alias("method"), ((F.size("methods") == 1) & (F.col("methods")[0] != wanted) & F.lit(requested is not None)).alias("ignored"))

"""Cell tables: centroids, relabelling, imported labels and centroid overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centroids(pixels: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("cell_area"))


def centroids_of_runs(runs: DataFrame) -> DataFrame:
    """The same from runs (slide_id, y, x_start, x_end, cell_id), without touching pixels."""
    n = F.col("x_end") - F.col("x_start")
    sums = runs.where("cell_id > 0").groupBy("slide_id", "cell_id").agg(F.sum(n).alias("cell_area"), F.sum((F.col("x_start") + F.col("x_end") - 1) / 2 * n).alias("sx"), F.sum(F.col("y") * n).alias("sy"))
    return sums.select("slide_id", "cell_id", (F.col("sx") / F.col("cell_area")).alias("x"), (F.col("sy") / F.col("cell_area")).alias("y"), "cell_area")


def relabel(cells: DataFrame, by: list[str], cell: str = "cell_id") -> DataFrame:
    """Consecutive ids from 1 in ascending order of the old ones, in each slide."""
    return cells.withColumn("new_id", F.row_number().over(Window.partitionBy(*by).orderBy(cell)))


def labels_known(labels: DataFrame, cells: DataFrame, key: str = "cell_id") -> DataFrame:
    return labels.join(cells.select(key), key, "left_semi")


def labels_unknown(labels: DataFrame, cells: DataFrame, key: str = "cell_id") -> DataFrame:
    return labels.join(cells.select(key), key, "left_anti")


def replace_label_set(existing: DataFrame, new: DataFrame, label_set: str) -> DataFrame:
    """Other sets stay; this one is replaced as a whole."""
    return existing.where(F.col("label_set") != label_set).unionByName(new.withColumn("label_set", F.lit(label_set)).select(*existing.columns))


def override_centroids(cells: DataFrame, given: DataFrame, runs: DataFrame) -> DataFrame:
    """Centroids given by hand count where they round to a pixel of their own cell."""
    at = given.select("slide_id", "cell_id", F.col("x").alias("gx"), F.col("y").alias("gy"), F.rint("y").cast("bigint").alias("_y"), F.rint("x").cast("bigint").alias("_x"))
    r = runs.select("slide_id", F.col("y").cast("bigint").alias("_y"), "x_start", "x_end", "cell_id")
    valid = at.join(r, ["slide_id", "_y", "cell_id"]).where("_x >= x_start and _x < x_end").select("slide_id", "cell_id", "gx", "gy").dropDuplicates(["slide_id", "cell_id"])
    out = cells.join(valid, ["slide_id", "cell_id"], "left")
    return out.withColumns({"x": F.coalesce("gx", "x"), "y": F.coalesce("gy", "y")}).drop("gx", "gy")


def cap_per_class(rows: DataFrame, label: str, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` rows of each class by an explicit, repeatable order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_r") <= limit).drop("_r")


def hashed_split(rows: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add validation: about ``share`` of the rows by their key's hash, the same whatever the partitions."""
    return rows.withColumn("validation", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))

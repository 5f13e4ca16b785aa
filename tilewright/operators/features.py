"""Per-patch features: the mean marker in plain expressions, other encoders behind one protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6  # fixed value of the mean marker's denominator


def nonzero_mean(value: Column, scale: Column | float = 1.0) -> Column:
    """Sum of scaled values over the number of non-zero ones; all zero gives 0."""
    return F.sum(value / scale) / (F.lit(EPSILON) + F.count_if(value != 0))


def mean_marker(pixels: DataFrame, by: list[str], value: str = "v", scale: float = 1.0) -> DataFrame:
    return pixels.groupBy(*by).agg(nonzero_mean(F.col(value), F.lit(scale)).alias("feature"))


def zscore(values: DataFrame, stats: DataFrame, value: str = "v", default: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(v - mean) / std by marker; defaults for markers without statistics."""
    joined = values.join(stats.select("marker", "mean", "std"), "marker", "left")
    z = (F.col(value) - F.coalesce("mean", F.lit(default[0]))) / F.coalesce(F.nullif(F.col("std"), F.lit(0.0)), F.lit(default[1]))
    return joined.withColumn("z", z).drop("mean", "std")


def with_positions(features: DataFrame, patches: DataFrame) -> DataFrame:
    return features.join(patches, ["slide_id", "slug", "patch_idx"])


def with_labels(cells: DataFrame, labels: DataFrame, label_set: str, key: str = "cell_id") -> DataFrame:
    """Left join of one label set; the set's name filters the labels before they are shuffled."""
    return cells.join(labels.where(F.col("label_set") == label_set).select(key, "label"), key, "left")


@dataclass
class Encoder:
    """What an encoder must give: a model made once a worker, a function of a batch, its size and needs."""

    name: str
    version: str
    embed_dim: int
    build: Callable[[], object]
    forward: Callable[[object, np.ndarray], np.ndarray]
    scale: bool = True
    required_markers: tuple[str, ...] = ()
    provenance: dict[str, list[str]] = field(default_factory=dict)


ENCODERS: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    if not isinstance(encoder, Encoder):
        raise TypeError("only an Encoder can be registered")
    ENCODERS[encoder.name] = encoder
    return encoder


def _projection() -> np.ndarray:
    return np.random.default_rng(0).standard_normal((64, 8)) / 8


#: A stand-in to exercise the path: a fixed random projection, not a trained model.
register(Encoder("random_projection", "1", 8, _projection, lambda model, x: x @ model))


def encode(patches: DataFrame, encoder: str, column: str, keys: list[str]) -> DataFrame:
    """keys, encoder, features of every row; the model is built once a task, batches come by Arrow."""
    e = ENCODERS[encoder]
    build, forward, name = e.build, e.forward, e.name

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for f in frames:
            if len(f):
                out = forward(model, np.stack(f[column].to_numpy()).astype(np.float64))
                yield f[keys].assign(encoder=name, features=list(out))

    fields = ", ".join(f"`{k}` {patches.schema[k].dataType.simpleString()}" for k in keys)
    return patches.select(*keys, column).mapInPandas(run, f"{fields}, encoder string, features array<double>")


def merge_feature_sets(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to do for each wanted (slide, slug, encoder, variant, markers): encode, skip, or conflict.

    Panels are compared in order, since columns follow it."""
    key = ["slide_id", "slug", "encoder", "variant"]
    have = existing.select(*key, F.col("markers_used").alias("_have"))
    action = F.when(F.col("_have").isNull(), "encode").when(F.col("_have") == F.col("markers_used"), "skip").otherwise("conflict")
    return wanted.join(have, key, "left").withColumn("action", action).drop("_have")


def center_crop(pixels: DataFrame, size: int, multiple: int = 14) -> DataFrame:
    """The middle of square patches, cut to a multiple, with places from 0."""
    kept = size // multiple * multiple
    low = (size - kept) // 2
    inside = pixels.where((F.col("x") >= low) & (F.col("x") < low + kept) & (F.col("y") >= low) & (F.col("y") < low + kept))
    return inside.withColumns({"x": F.col("x") - low, "y": F.col("y") - low})


def embedding_stats(vectors: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count, mean and sample deviation of each component in each group."""
    long = vectors.select(*by, F.posexplode(column).alias("dim", "v"))
    return long.groupBy(*by, "dim").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def balanced_weights(rows: DataFrame, label: str, sampler: bool = False) -> DataFrame:
    """Add weight: n / (classes * n of the class), or 1 / n of the class for a sampler."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()
    counts = counts.withColumn("weight", 1.0 / F.col("_n") if sampler else F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n")))
    return rows.join(F.broadcast(counts.drop("_n")) if counts.limit(10_001).count() <= 10_000 else counts.drop("_n"), label)

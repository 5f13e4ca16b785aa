"""Colour and display arithmetic on long pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published channel means and deviations of the common RGB pretraining set.
RGB_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
RGB_STD = {"r": 0.229, "g": 0.224, "b": 0.225}


def colourize(pixels: DataFrame, colours: DataFrame, value: str = "v") -> DataFrame:
    """Each channel in its own colour, scaled by its value; colours(channel_idx, r, g, b)."""
    joined = pixels.join(colours, "channel_idx")
    return joined.withColumns({c: F.col(value) * F.col(c) for c in "rgb"})


def normalize_rgb(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: (F.col(c) - RGB_MEAN[c]) / RGB_STD[c] for c in "rgb"})


def min_max_composite(pixels: DataFrame, colours: DataFrame, gain: float = 2.0, value: str = "v") -> DataFrame:
    """Channels stretched to their own range, blended by colour, times ``gain``, clipped to 0..255."""
    bounds = pixels.groupBy("channel_idx").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = pixels.join(bounds, "channel_idx").withColumn("s", F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    blended = scaled.join(colours, "channel_idx").groupBy("y", "x").agg(*(F.sum(F.col("s") * F.col(c)).alias(c) for c in "rgb"))
    return blended.withColumns({c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) * gain * 255))).cast("int") for c in "rgb"})


def stain_rgb(byte: Column, invert: bool = False) -> Column:
    """One 8-bit stain as three equal channels, dark on light where inverted."""
    v = F.lit(255) - byte if invert else byte
    return F.struct(v.alias("r"), v.alias("g"), v.alias("b"))


def tile_vote(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pixels that the mean of all tiles over them puts at the threshold or above."""
    return predictions.groupBy("slide_id", "y", "x").agg(F.avg("p").alias("p")).where(F.col("p") >= threshold)


def resample(tiles: DataFrame, factor: float, nearest: bool = False) -> DataFrame:
    """Tiles (…, h, w, dtype, data) scaled down by ``factor`` (at least 1), bilinear at pixel centres or nearest."""
    if factor < 1:
        raise ValueError("resampling never enlarges")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                a = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["h"], r["w"])
                h, w = max(1, round(r["h"] / factor)), max(1, round(r["w"] / factor))
                y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, r["h"]), (w, r["w"])))
                if nearest:
                    b = a[np.rint(y).astype(int)][:, np.rint(x).astype(int)]
                else:
                    y0, x0 = np.minimum(y.astype(int), max(0, r["h"] - 2)), np.minimum(x.astype(int), max(0, r["w"] - 2))
                    y1, x1 = np.minimum(y0 + 1, r["h"] - 1), np.minimum(x0 + 1, r["w"] - 1)
                    fy, fx = (y - y0)[:, None], x - x0
                    b = (a[y0][:, x0] * (1 - fy) + a[y1][:, x0] * fy) * (1 - fx) + (a[y0][:, x1] * (1 - fy) + a[y1][:, x1] * fy) * fx
                    b = np.rint(b) if np.issubdtype(a.dtype, np.integer) else b
                out.append(r | {"h": h, "w": w, "data": np.ascontiguousarray(b.astype(a.dtype)).tobytes()})
            yield pd.DataFrame(out, columns=f.columns)

    return tiles.mapInPandas(run, tiles.schema)

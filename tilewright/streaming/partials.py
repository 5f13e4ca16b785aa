"""Marker statistics that follow arriving pixels: an extension, since partials merge exactly.

Each micro-batch appends its partials under its own batch id, so a batch that is run again
after a failure overwrites itself and nothing counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import pool, slide_partials


def follow(pixels: DataFrame, store: str, checkpoint: str, value: str = "v") -> StreamingQuery:
    """Read what is there, write partials by batch, stop."""

    def save(batch: DataFrame, batch_id: int) -> None:
        slide_partials(batch, value).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return pixels.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pooled(spark: SparkSession, store: str) -> DataFrame:
    """Pooled statistics over all batches so far."""
    return pool(spark.read.parquet(store))


def windowed_means(events: DataFrame, time: str, marker: str, value: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Means by event-time window; rows later than ``late`` no longer count."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), marker).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))

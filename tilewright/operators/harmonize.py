"""Layouts of source images brought to one channel a plane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Axis strings of sources. P: a plane is a channel; S: a sample of the only plane is one;
# PS: planes come first, then their samples.
LAYOUTS = {"CYX": "P", "TCYX": "P", "ZCYX": "P", "QYX": "P", "YX*": "P", "YXC": "S", "YXS": "S", "TYXC": "PS", "ZYXC": "PS", "QYXS": "PS"}
GUESSED = ("QYX",)  # whose first axis has no name, and is taken for channels


def harmonize(planes: DataFrame) -> DataFrame:
    """planes(slide_id, axes, page, n_pages, sample, n_samples, ...) with channel_idx and assumed.

    Pages count all leading axes in order, so that channel t * C + c is channel c of cycle t. Unknown layouts, samples
    where a layout has none, and pages where it has one are errors."""
    of = lambda kind: F.col("axes").isin(*(k for k, v in LAYOUTS.items() if v == kind))
    page, sample = F.col("page").cast("int"), F.col("sample").cast("int")
    flat = F.concat(F.lit("more samples or pages than layout "), F.col("axes"), F.lit(" has on slide "), F.col("slide_id").cast("string"))
    index = (
        F.when(of("P"), F.when(F.col("n_samples") == 1, page).otherwise(F.raise_error(flat).cast("int")))
        .when(of("S"), F.when(F.col("n_pages") == 1, sample).otherwise(F.raise_error(flat).cast("int")))
        .when(of("PS"), page * F.col("n_samples").cast("int") + sample)
        .otherwise(F.raise_error(F.concat(F.lit(f"layouts known are {', '.join(sorted(LAYOUTS))}, not "), F.coalesce("axes", F.lit("none")))).cast("int"))
    )
    return planes.withColumns({"channel_idx": index, "assumed": F.col("axes").isin(*GUESSED)})


def cycles(channels: DataFrame, per_cycle: int) -> DataFrame:
    """Add the cycle a channel was stained in."""
    return channels.withColumn("cycle", F.floor(F.col("channel_idx") / per_cycle).cast("int"))


def name_channels(channels: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """channels(slide_id, channel_idx, raw) with names(channel_idx, raw) in place of their own, if they are as many on every
    slide; channels without a name are called by number."""
    if names is not None:
        counts = channels.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
        n = names.count()
        odd = [(r["slide_id"], r["n"]) for r in counts.where(F.col("n") != n).orderBy("slide_id").limit(5).collect()]
        if odd:
            raise ValueError(f"{n} names do not fit slides with other numbers of channels: {odd}")
        channels = channels.drop("raw").join(names.select("channel_idx", "raw"), "channel_idx")
    return channels.withColumn("raw", F.coalesce("raw", F.concat(F.lit("channel_"), F.col("channel_idx"))))

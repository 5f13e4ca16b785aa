"""The stages of a job over a cohort: source files to tiles, tissue, patches and features, as tables in a job folder.

Each stage checks what it needs before it writes, works on all slides that have not completed it, and records them. Slides are
rows: one Spark job takes the cohort, and no slide's pixels pass through the driver."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.names import clean_marker_name, output_stem, scaling_factor, slide_id
from ..operators import checks, cohort, features, morphology, raster, spatial
from ..sources import images, tables
from . import state, workflow
from .config import PatchConfig


def _read(spark: SparkSession, job: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{job}/{name}")


def _pending(spark: SparkSession, job: str, slides: DataFrame, stage: str, key: str = "") -> list[str]:
    done = state.load_tasks(spark, job).where((F.col("stage") == stage) & (F.col("key") == key) & (F.col("status") == "completed"))
    return [r["slide_id"] for r in slides.join(done, "slide_id", "left_anti").select("slide_id").orderBy("slide_id").collect()]


def ingest(
    spark: SparkSession, source: str, job: str, registry: DataFrame, mpp: float | None = None, mpp_table: DataFrame | None = None, channel_names: DataFrame | None = None,
    nuclear: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
) -> DataFrame:
    """The slides of a folder of TIFF files, written as tiles, channels and slides; slides ingested before are left alone.

    The marker map is written for review where the job has none, and applied as it stands where it has one."""
    pages = images.read_tiff(spark, source)
    files = pages.groupBy("file").agg(F.count(F.lit(1)).alias("n_markers"), F.min("height").alias("height"), F.max("height").alias("_h"), F.min("width").alias("width"), F.max("width").alias("_w"), F.min("dtype").alias("dtype"), F.max("mpp").alias("mpp"), F.max("description").alias("description"))
    files = files.withColumn("slide_id", slide_id(F.col("file")))
    wanted = _pending(spark, job, files, "ingest")
    listed = [r for r in files.collect() if r["slide_id"] in set(wanted)]
    if not listed:
        return _read(spark, job, "slides")
    uneven = [r["file"] for r in listed if (r["height"], r["width"]) != (r["_h"], r["_w"])]
    if uneven:
        raise ValueError(f"planes of different sizes in {uneven[:5]}")
    if channel_names is not None:
        given = [r["raw"] for r in channel_names.orderBy("channel_idx").collect()]
        odd = [(r["file"], r["n_markers"]) for r in listed if r["n_markers"] != len(given)]
        if odd:
            raise ValueError(f"{len(given)} names do not fit {odd[:5]}")
        named = {r["file"]: given for r in listed}
    else:
        named = {r["file"]: images.channel_names(r["description"] or "", r["n_markers"]) for r in listed}
    sized = []
    for r in listed:
        _, ome = images.ome_metadata(r["description"] or "")
        sized.append((r["slide_id"], r["file"], r["height"], r["width"], r["n_markers"], ome or r["mpp"], r["dtype"]))
    rows = [(r["slide_id"], i, raw) for r in listed for i, raw in enumerate(named[r["file"]])]
    channels = spark.createDataFrame(rows, "slide_id string, channel_idx int, raw string")
    reviewed = tables.read_marker_map(spark, f"{job}/marker_map") if Path(job, "marker_map").exists() else None
    kept, resolution = cohort.resolve_cohort_markers(channels, registry, reviewed, include, exclude)
    channels = channels.withColumns({"raw": F.coalesce("raw", F.concat(F.lit("channel_"), F.col("channel_idx"))), "match": F.lit(None).cast("string"), "keep": F.lit(True)})
    channels = cohort.apply_names(channels.withColumn("marker", clean_marker_name(F.col("raw"))), resolution, set_keep=True)
    slides = spark.createDataFrame(sized, "slide_id string, name string, height int, width int, n_markers int, mpp double, dtype string")
    bad = checks.unsupported_types(slides).orderBy("name").limit(checks.SHOWN).collect()
    if bad:
        raise ValueError(f"pixel types without a scale: {[(r['name'], r['dtype']) for r in bad]}")
    slides = workflow.resolve_mpp(slides, mpp_table if mpp_table is not None else spark.createDataFrame([], schemas.MPP_TABLE), mpp)
    slides = slides.withColumn("mpp_plausible", checks.mpp_plausible(F.col("mpp")))
    stain = cohort.resolve_nuclear(channels, nuclear).withColumnRenamed("nuclear_idx", "channel_idx")
    slides = slides.join(stain.join(channels, ["slide_id", "channel_idx"]).select("slide_id", F.col("marker").alias("nuclear_marker")), "slide_id")
    slides.count()  # every check above, before anything is written
    own = pages.withColumn("slide_id", slide_id(F.col("file"))).where(F.col("slide_id").isin(wanted)).withColumn("channel_idx", F.col("page"))
    floats = own.where(F.col("dtype").startswith("float"))
    if any(r["dtype"].startswith("float") for r in listed):
        off = raster.check_float_range(images.pixels(images.tiles(floats))).orderBy("channel_idx").limit(checks.SHOWN).collect()
        if off:
            raise ValueError(f"channels with values outside 0 to 1: {[r['channel_idx'] for r in off]}")
    with state.task(job, wanted, "ingest", image="tiles"):
        images.tiles(own).write.mode("append").partitionBy("slide_id", "channel_idx").option("compression", "zstd").parquet(f"{job}/tiles")
        channels.write.mode("append").parquet(f"{job}/channels")
        slides.write.mode("append").parquet(f"{job}/slides")
        if reviewed is None:
            kept.select("original_name", "mapped_canonical_name", "status").withColumns({"suggestion_1": F.lit(""), "suggestion_2": F.lit("")}).coalesce(1).write.option("header", True).csv(f"{job}/marker_map")
    return _read(spark, job, "slides")


def sync_names(spark: SparkSession, job: str, registry: DataFrame) -> DataFrame:
    """Bring recorded channels in line with the reviewed map; pixels are not read. Returns the slides that changed."""
    reviewed = tables.read_marker_map(spark, f"{job}/marker_map")
    channels = spark.createDataFrame(_read(spark, job, "channels").collect(), _read(spark, job, "channels").schema)  # a row a channel
    _, synced, changed = cohort.enforce(reviewed, registry, channels)
    listed = [r["slide_id"] for r in changed.orderBy("slide_id").collect()]
    if listed:
        synced.write.mode("overwrite").parquet(f"{job}/channels")
    return spark.createDataFrame([(s,) for s in listed], "slide_id string")


def detect_tissue(spark: SparkSession, job: str, factor: float = 0.7, least: int = 64, hole: int = 64, radius: int = 2) -> DataFrame:
    """Runs of pixels over ``factor`` times the nuclear stain's Otsu threshold after a stretch, without specks and holes."""
    slides, channels = _read(spark, job, "slides"), _read(spark, job, "channels")
    wanted = _pending(spark, job, slides, "tissue", "otsu")
    if not wanted:
        return _read(spark, job, "tissue")
    stain = cohort.resolve_nuclear(channels.where(F.col("slide_id").isin(wanted))).select("slide_id", F.col("nuclear_idx").alias("channel_idx"))
    tiles = _read(spark, job, "tiles").where(F.col("slide_id").isin(wanted)).join(F.broadcast(stain), ["slide_id", "channel_idx"])  # a row a slide
    px = images.pixels(tiles)
    bounds = raster.percentile_bounds(px, ["slide_id"], "v", subsample=4)
    px = px.join(bounds, "slide_id").withColumn("v", raster.stretch(F.col("v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    cut = raster.otsu_threshold(px, ["slide_id"], "v")
    over = px.join(cut, "slide_id").where(F.col("v") > F.col("threshold") * factor)
    runs = over.select("slide_id", "y", F.col("x").alias("x_start"), (F.col("x") + 1).alias("x_end"))
    frames = slides.where(F.col("slide_id").isin(wanted)).select("slide_id", "height", "width")
    with state.task(job, wanted, "tissue", "otsu", mask="tissue"):
        clean, _ = morphology.cleanup(runs, frames, least, hole, radius, connectivity=4)
        clean.withColumn("method", F.lit("otsu")).write.mode("append").parquet(f"{job}/tissue")
    return _read(spark, job, "tissue")


def extract_patches(spark: SparkSession, job: str, config: PatchConfig, method: str | None = None) -> DataFrame:
    """Every patch of the grid with its tissue fraction, or a patch a cell on its centre."""
    slides = _read(spark, job, "slides")
    base = [(r["slide_id"], config.slug(r["mpp"])) for r in slides.select("slide_id", "mpp").collect()]
    slugs = spark.createDataFrame(base, "slide_id string, slug string")
    key = f"{config.patch_size}_{config.step}_{config.mode}"
    wanted = _pending(spark, job, slides, "patch", key)
    if wanted:
        own = slides.where(F.col("slide_id").isin(wanted))
        if config.mode == "grid":
            tissue = _read(spark, job, "tissue") if Path(job, "tissue").exists() else None
            if tissue is None:
                raise ValueError("no tissue mask; detect tissue first")
            chosen = checks.tissue_method(tissue.select("slide_id", "method").distinct(), method).select("slide_id", "method")
            runs = tissue.join(chosen, ["slide_id", "method"])
            out = spatial.tissue_fraction(spatial.grid(own, config.patch_size, config.step), runs, config.patch_size).withColumn("cell_id", F.lit(None).cast("int"))
        else:
            if not Path(job, "cells").exists():
                raise ValueError("no cells; import a cell mask first")
            cells = _read(spark, job, "cells").where(F.col("slide_id").isin(wanted))
            out = cells.select("slide_id", F.col("cell_id").cast("bigint").alias("patch_idx"), spatial.box_origin(F.col("x"), config.patch_size).alias("x"), spatial.box_origin(F.col("y"), config.patch_size).alias("y"), F.lit(None).cast("float").alias("tissue_prop"), F.col("cell_id").cast("int").alias("cell_id"))
        with state.task(job, wanted, "patch", key, coords="patches"):
            out.join(slugs, "slide_id").withColumn("size", F.lit(config.patch_size)).write.mode("append").partitionBy("slug").parquet(f"{job}/patches")
    return _read(spark, job, "patches").join(slugs, ["slide_id", "slug"])


def encode_mean_marker(spark: SparkSession, job: str, config: PatchConfig, variant: str = "markers_all", include: list[str] | None = None) -> DataFrame:
    """(slide_id, slug, patch_idx, marker, feature): the mean marker of kept channels, scaled to 0 to 1, of every patch."""
    from ..operators import markers

    slides, channels = _read(spark, job, "slides"), _read(spark, job, "channels")
    panel = markers.apply_panel(channels, include).select("slide_id", "channel_idx", "marker")
    patches = _read(spark, job, "patches").where(F.col("size") == config.patch_size)
    key = f"{config.patch_size}_{config.step}_{config.mode}_{variant}"
    wanted = _pending(spark, job, slides, "extract", key)
    if wanted:
        tiles = _read(spark, job, "tiles").where(F.col("slide_id").isin(wanted)).join(panel, ["slide_id", "channel_idx"])
        px = images.pixels(tiles, nonzero=True).select("slide_id", "channel_idx", F.col("x").alias("px"), F.col("y").alias("py"), "v")
        scale = slides.select("slide_id", scaling_factor(F.col("dtype")).alias("scale"))
        inside = spatial.box_points(patches.where(F.col("slide_id").isin(wanted)).select("slide_id", "slug", "patch_idx", "x", "y"), px, config.patch_size)
        found = inside.join(scale, "slide_id").groupBy("slide_id", "slug", "patch_idx", "channel_idx").agg(features.nonzero_mean(F.col("v"), F.col("scale")).alias("feature"))
        every = patches.where(F.col("slide_id").isin(wanted)).select("slide_id", "slug", "patch_idx").join(panel, "slide_id")  # patches without a pixel have 0
        out = every.join(found, ["slide_id", "slug", "patch_idx", "channel_idx"], "left").na.fill(0.0, ["feature"]).withColumn("variant", F.lit(variant))
        with state.task(job, wanted, "extract", key, features="features"):
            out.write.mode("append").partitionBy("variant").parquet(f"{job}/features")
    return _read(spark, job, "features").where(F.col("variant") == variant)


def status(spark: SparkSession, job: str) -> DataFrame:
    """A row a stage: slides completed and in all, with the first error."""
    tasks = state.load_tasks(spark, job).where("not unreadable")
    stages = workflow.stage_collapse(tasks, ["slide_id", "stage"])
    return stages.groupBy("stage").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("total"), F.min("first_error").alias("first_error"))

"""CSV, text, JSON and GeoJSON tables, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_text_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All columns as text, '#' lines skipped, missing cells blank. Columns go by name, absent ones are blank."""
    names = [c.split()[0] for c in ddl.split(",")]
    raw = spark.read.option("header", True).option("comment", "#").option("inferSchema", False).csv(path)
    return raw.select(*((F.col(n) if n in raw.columns else F.lit(None).cast("string")).alias(n) for n in names)).na.fill("")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path, schemas.REGISTRY)


def read_marker_map(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path, schemas.MARKER_MAP)


def read_additional_markers(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path, schemas.ADDITIONAL_MARKERS)


def read_mpp_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MPP_TABLE).option("header", True).csv(path)


def read_channel_names(spark: SparkSession, path: str) -> DataFrame:
    """(channel_idx, raw): one name a line, trimmed, blank lines dropped, in file order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(name_lines(F.col("value"))).alias("channel_idx", "raw"))


def name_lines(text: Column) -> Column:
    """The lines of a text without white space around them, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, tissue_id, rings): polygons, multipolygons taken apart, in file order; other geometries are left out."""
    geometry = "struct<type:string,coordinates:string>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"struct<features:array<struct<geometry:{geometry}>>>").alias("g"))
    features = text.select("file", F.posexplode("g.features.geometry").alias("feature", "geometry"))
    polygon, multi = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", polygon))).when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", multi))
    shapes = features.select("file", "feature", F.posexplode(parts).alias("part", "shape"))
    rings = F.transform("shape", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    numbered = shapes.select("file", F.col("feature"), F.col("part"), rings.alias("rings"))
    per_file = numbered.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("feature", "part", "rings"))).alias("all"))
    return per_file.select("file", F.posexplode("all").alias("tissue_id", "s")).select("file", "tissue_id", F.col("s.rings").alias("rings"))


def write_geojson(polygons: DataFrame, path: str, name: str = "Tissue") -> None:
    """One feature collection a slide, as a JSON line each."""
    closed = F.transform("rings", lambda r: F.concat(F.transform(r, lambda p: F.array(p["x"], p["y"])), F.slice(F.transform(r, lambda p: F.array(p["x"], p["y"])), 1, 1)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates")).alias("geometry"), F.struct(F.struct(F.lit(name).alias("name")).alias("classification")).alias("properties"))
    rows = polygons.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("tissue_id", feature.alias("f")))).alias("fs"))
    rows.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda s: s["f"]).alias("features"))).alias("value")).write.mode("overwrite").text(path)


def write_slides(tiles: DataFrame, path: str) -> None:
    """The canonical store: tiles by slide and channel, so that a marker's files are read alone."""
    tiles.repartition("slide_id", "channel_idx").sortWithinPartitions("slide_id", "channel_idx", "ty", "tx").write.mode("overwrite").partitionBy("slide_id", "channel_idx").option("compression", "zstd").parquet(path)

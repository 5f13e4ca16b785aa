"""Pixel sources: TIFF files and raw arrays to tile rows, tiles to pixels.

Files reach the workers through Spark's own ``binaryFile`` reader, so any store that Spark
reads will do. Only uncompressed and zlib data are decoded here."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 1024
# Fixed values of the TIFF format: tag numbers and field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, X_RESOLUTION, RESOLUTION_UNIT, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 282, 296, 339
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8, 18: 8}
UNITS = {"µm": 1.0, "um": 1.0, "nm": 0.001}
PER_UNIT = {2: 25400.0, 3: 10000.0}
PAGES = "file string, page int, height int, width int, dtype string, mpp double, description string, data binary"


def tiff_pages(raw: bytes) -> Iterator[dict]:
    """The pages of a TIFF, classic or big, in strips or tiles: size, type, resolution, description and samples.

    What is not decoded is an error, never other pixels."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    magic = struct.unpack_from(order + "H", raw, 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    place_of, count_of, entry, inline = (order + "Q", order + "Q", 20, 8) if big else (order + "I", order + "H", 12, 4)
    lead = struct.calcsize(count_of)
    at = struct.unpack_from(place_of, raw, 8 if big else 4)[0]
    while at:
        n = struct.unpack_from(count_of, raw, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(n):
            own = at + lead + entry * i
            tag, kind = struct.unpack_from(order + "HH", raw, own)
            count = struct.unpack_from(place_of, raw, own + 4)[0]
            size = SIZES.get(kind, 1) * count
            value_at = own + entry - inline
            place = value_at if size <= inline else struct.unpack_from(place_of, raw, value_at)[0]
            body = raw[place : place + size]
            if kind == 2:
                tags[tag] = (body.rstrip(b"\0").decode("utf-8", "replace"),)
            elif kind == 5:
                tags[tag] = struct.unpack(order + "II" * count, body)
            else:
                tags[tag] = struct.unpack(order + {1: "B", 3: "H", 4: "I", 16: "Q", 18: "Q"}.get(kind, "B") * count, body)
        packed = tags.get(COMPRESSION, (1,))[0]
        if packed not in (1, 8, 32946):
            raise ValueError(f"TIFF compression {packed} is not supported")
        samples, predictor = tags.get(SAMPLES, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        bits = tags.get(BITS, (8,))[0]
        kind = {1: "uint", 2: "int", 3: "float"}.get(tags.get(FORMAT, (1,))[0])
        if kind is None or bits not in (8, 16, 32, 64) or len(set(tags.get(BITS, (8,)))) > 1:
            raise ValueError(f"TIFF samples of {bits} bits in format {tags.get(FORMAT)} are not supported")
        if samples > 1 and tags.get(PLANAR, (1,))[0] != 1:
            raise ValueError("TIFF samples in separate planes are not supported")
        if predictor not in (1, 2) or (predictor == 2 and kind == "float"):
            raise ValueError(f"TIFF predictor {predictor} is not supported")
        stored = np.dtype(f"{order}{kind[0]}{bits // 8}")

        def block(offset: int, size: int, height: int, width: int) -> np.ndarray:
            part = raw[offset : offset + size]
            a = np.frombuffer(zlib.decompress(part) if packed != 1 else part, stored)[: height * width * samples].reshape(height, width, samples)
            return np.cumsum(a, axis=1, dtype=stored.newbyteorder("=")) if predictor == 2 else a

        height, width = tags[HEIGHT][0], tags[WIDTH][0]
        image = np.zeros((height, width, samples), stored.newbyteorder("="))
        if TILE_OFFSETS in tags:
            th, tw = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]
            across = -(-width // tw)
            for i, (o, b) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_BYTES], strict=True)):
                y, x = i // across * th, i % across * tw
                part = block(o, b, th, tw)
                image[y : y + th, x : x + tw] = part[: height - y, : width - x]
        else:
            rows = min(tags.get(ROWS_PER_STRIP, (height,))[0], height)
            for i, (o, b) in enumerate(zip(tags[STRIP_OFFSETS], tags[STRIP_BYTES], strict=True)):
                y = i * rows
                image[y : y + rows] = block(o, b, min(rows, height - y), width)
        data = image.astype(image.dtype.newbyteorder("<"), copy=False).tobytes()
        num, den = tags.get(X_RESOLUTION, (0, 1))[:2]
        unit = PER_UNIT.get(tags.get(RESOLUTION_UNIT, (2,))[0])
        yield {
            "height": height, "width": width, "samples": samples, "dtype": f"{kind}{bits}",
            "mpp": unit / (num / den) if unit and num and den else None, "description": tags.get(DESCRIPTION, ("",))[0], "data": data,
        }
        at = struct.unpack_from(place_of, raw, at + lead + entry * n)[0]


def ome_metadata(text: str) -> tuple[list[str] | None, float | None]:
    """Channel names and microns a pixel of an OME description; a unit it does not know gives no size."""
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None, None
    local = lambda e: e.tag.rpartition("}")[2]
    channels = [e.get("Name") or e.get("ID") or "" for e in root.iter() if local(e) == "Channel"]
    pixels = next((e for e in root.iter() if local(e) == "Pixels"), None)
    size = float(pixels.get("PhysicalSizeX")) if pixels is not None and pixels.get("PhysicalSizeX") else None
    scale = UNITS.get(pixels.get("PhysicalSizeXUnit", "µm")) if pixels is not None else None
    return channels or None, size * scale if size and scale else None


def channel_names(description: str, n: int) -> list[str | None]:
    """OME names where there are ``n``, else ImageJ labels where there are ``n``, else none."""
    names, _ = ome_metadata(description)
    if names and len(names) == n:
        return names
    labels = re.findall(r"(?m)^Labels?=(.*)$", description)
    found = labels[0].split(",") if labels else []
    return [x.strip() for x in found] if len(found) == n else [None] * n


def read_tiff(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """One row a page of all TIFF files under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                for i, p in enumerate(tiff_pages(content)):
                    if p["samples"] > 1:  # channel-last: one page a sample
                        a = np.frombuffer(p["data"], np.dtype(p["dtype"])).reshape(-1, p["samples"])
                        planes = [np.ascontiguousarray(a[:, s]).tobytes() for s in range(p["samples"])]
                    else:
                        planes = [p["data"]]
                    for s, data in enumerate(planes):
                        yield pd.DataFrame([{"file": name.rpartition("/")[2], "page": i * len(planes) + s, "height": p["height"], "width": p["width"], "dtype": p["dtype"], "mpp": p["mpp"], "description": p["description"] if i == 0 else None, "data": data}])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, PAGES)


def read_channel_dir(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """A directory of one-channel files as channels of a slide: (channel_idx, raw, height, width, dtype, mpp, data), by file name.

    Files of several pages or samples, of another size or type, or that disagree on their resolution are errors."""
    from ..functions.names import output_stem
    from ..plans.workflow import uniform_mpp

    pages = read_tiff(spark, path, pattern)
    kinds = pages.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("height").alias("height"), F.min("width").alias("width"), F.min("dtype").alias("dtype"), F.min("mpp").alias("mpp"))
    kinds = kinds.withColumn("channel_idx", F.row_number().over(Window.orderBy("file")) - 1)  # a row a file
    listed = kinds.orderBy("file").collect()
    if not listed:
        raise ValueError(f"no channel files in {path}")
    several = [r["file"] for r in listed if r["n"] > 1]
    if several:
        raise ValueError(f"files of more than one plane: {several[:5]}")
    if len({(r["height"], r["width"], r["dtype"]) for r in listed}) > 1:
        raise ValueError(f"files of different sizes or types: {[(r['file'], r['height'], r['width'], r['dtype']) for r in listed][:5]}")
    mpp = uniform_mpp(kinds.withColumn("dir", F.lit(1)), ["dir"]).first()["mpp"]
    numbers = spark.createDataFrame([(r["file"], r["channel_idx"]) for r in listed], "file string, channel_idx int")
    return pages.join(numbers, "file").select("channel_idx", output_stem(F.col("file")).alias("raw"), "height", "width", "dtype", F.lit(mpp).cast("double").alias("mpp"), "data")


def tiles(pages: DataFrame, tile: int = TILE) -> DataFrame:
    """Pages (slide_id, channel_idx, height, width, dtype, data) cut into tile rows."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a = np.frombuffer(r.data, np.dtype(r.dtype)).reshape(r.height, r.width)
                for y in range(0, r.height, tile):
                    for x in range(0, r.width, tile):
                        part = np.ascontiguousarray(a[y : y + tile, x : x + tile])
                        yield pd.DataFrame([{"slide_id": r.slide_id, "channel_idx": r.channel_idx, "ty": y // tile, "tx": x // tile, "y0": y, "x0": x, "h": part.shape[0], "w": part.shape[1], "dtype": r.dtype, "data": part.tobytes()}])

    from .. import schemas

    return pages.select("slide_id", "channel_idx", "height", "width", "dtype", "data").mapInPandas(cut, schemas.TILES)


def pixels(tile_rows: DataFrame, nonzero: bool = False) -> DataFrame:
    """Tiles as long rows (slide_id, channel_idx, y, x, v), a tile at a time; zeros may be left out."""

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a = np.frombuffer(r.data, np.dtype(r.dtype)).reshape(r.h, r.w)
                y, x = np.nonzero(a) if nonzero else (g.reshape(-1) for g in np.indices(a.shape))
                yield pd.DataFrame({"slide_id": r.slide_id, "channel_idx": r.channel_idx, "y": (y + r.y0).astype(np.int32), "x": (x + r.x0).astype(np.int32), "v": a[y, x].astype(np.float64)})

    from .. import schemas

    return tile_rows.select("slide_id", "channel_idx", "y0", "x0", "h", "w", "dtype", "data").mapInPandas(explode, schemas.PIXELS)


def mask_runs(tile_rows: DataFrame) -> DataFrame:
    """Instance masks as runs (slide_id, y, x_start, x_end, cell_id); runs end at tile borders."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a = np.frombuffer(r.data, np.dtype(r.dtype)).reshape(r.h, r.w).astype(np.int64)
                change = np.ones((r.h, r.w), bool)
                change[:, 1:] = a[:, 1:] != a[:, :-1]
                y, x = np.nonzero(change)
                end = np.append(x[1:], r.w)
                end[np.append(y[1:] != y[:-1], True)] = r.w
                keep = a[y, x] != 0
                yield pd.DataFrame({"slide_id": r.slide_id, "y": (y + r.y0)[keep], "x_start": (x + r.x0)[keep], "x_end": (end + r.x0)[keep], "cell_id": a[y, x][keep]})

    return tile_rows.select("slide_id", "y0", "x0", "h", "w", "dtype", "data").mapInPandas(run, "slide_id string, y int, x_start int, x_end int, cell_id int")


def cycle_index(page: int, channels_per_cycle: int) -> tuple[int, int]:
    return divmod(page, channels_per_cycle)


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a version-2 array with raw or zlib data: (chunk, shape, dtype, data)."""
    meta = json.loads(spark.read.text(f"{path}/.zarray", wholetext=True).first()[0])
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, "zlib"):
        raise ValueError(f"zarr codec {codec} is not supported")
    chunks, dtype = meta["chunks"], meta["dtype"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p.rpartition("/")[2], zlib.decompress(c) if codec else bytes(c)) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame([{"chunk": [int(i) for i in re.split(r"[./]", n)], "shape": chunks, "dtype": dtype, "data": c} for n, c in rows])

    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"/[0-9.]+$"))
    return files.select("path", "content").mapInPandas(run, "chunk array<int>, shape array<int>, dtype string, data binary")

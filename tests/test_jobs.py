"""Ingest to features on small files, and the cohort's names."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_imaging import tiff
from tilewright.operators import checks, cohort, harmonize, learning, raster
from tilewright.plans import jobs, state
from tilewright.plans.config import PatchConfig
from tilewright.sources import images

OME = '<OME><Image><Pixels PhysicalSizeX="0.5" PhysicalSizeXUnit="um"><Channel Name="DAPI"/><Channel Name="cd-3"/><Channel Name="blank 1"/></Pixels></Image></OME>'
MAP = "original_name string, mapped_canonical_name string, status string"


def registry(spark):
    return spark.createDataFrame([("DAPI", "nuclear"), ("CD3", "immune"), ("PanCK", "epithelial_keratin")], "marker_name string, family string")


def test_job_from_files_to_features(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = np.zeros((3, 64, 64), np.uint16)
    a[0, 8:40, 8:40] = rng.integers(3000, 4000, (32, 32))
    a[1] = rng.integers(0, 3, (64, 64)) * 1000
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1.ome.tiff").write_bytes(tiff(list(a), OME))
    job = str(tmp_path / "job")
    slides = jobs.ingest(spark, str(tmp_path / "in"), job, registry(spark)).collect()
    assert [(s["name"], s.height, s.n_markers, s.mpp, s.nuclear_marker, s.mpp_plausible) for s in slides] == [("s1.ome.tiff", 64, 3, 0.5, "DAPI", True)]
    got = {r.raw: (r.marker, r.match, r["keep"]) for r in spark.read.parquet(f"{job}/channels").collect()}
    assert got == {"DAPI": ("DAPI", "RESOLVED", True), "cd-3": ("CD3", "RESOLVED", True), "blank 1": ("blank 1", "RESOLVED", False)}
    assert jobs.ingest(spark, str(tmp_path / "in"), job, registry(spark)).count() == 1  # left alone
    config = PatchConfig(32)
    with pytest.raises(ValueError, match="tissue"):
        jobs.extract_patches(spark, job, config)
    runs = jobs.detect_tissue(spark, job)
    area = runs.agg(F.sum(F.col("x_end") - F.col("x_start"))).first()[0]
    assert 0.9 * 32 * 32 < area < 1.2 * 32 * 32
    patches = {r.patch_idx: (r.x, r.y, r.tissue_prop) for r in jobs.extract_patches(spark, job, config).collect()}
    assert len(patches) == 4 and patches[0][2] > 0.5 and patches[3][2] < 0.1
    out = {(r.patch_idx, r.marker): r.feature for r in jobs.encode_mean_marker(spark, job, config).collect()}
    for p, (x, y, _) in patches.items():
        for i, m in enumerate(("DAPI", "CD3")):
            v = a[i, y : y + 32, x : x + 32] / 65535
            assert np.isclose(out[p, m], v.sum() / (1e-6 + (v != 0).sum()))
    assert {r.stage: (r.completed, r.total) for r in jobs.status(spark, job).collect()} == {s: (1, 1) for s in ("ingest", "tissue", "patch", "extract")}
    (tmp_path / "job" / "state" / "broken.json").write_text("{")
    assert state.load_tasks(spark, job).where("unreadable").count() == 1
    assert jobs.sync_names(spark, job, registry(spark)).count() == 0


def test_guardrail(spark):
    channels = spark.createDataFrame([("s", 0, "DAPI", "DAPI", "RESOLVED", True), ("s", 1, "x", "x", "REVIEW", True), ("t", 0, "DAPI", "DAPI", "RESOLVED", True)], "slide_id string, channel_idx int, raw string, marker string, match string, keep boolean")
    good = spark.createDataFrame([("DAPI", "DAPI", "RESOLVED"), ("x", "CD3", "REVIEW")], MAP)
    promoted, synced, changed = cohort.enforce(good, registry(spark), channels)
    assert {r.status for r in promoted.collect()} == {"RESOLVED"} and [r.slide_id for r in changed.collect()] == ["s"]
    assert {(r.slide_id, r.raw): r.marker for r in synced.collect()}["s", "x"] == "CD3"
    report = cohort.inspect(good, registry(spark), channels).first()
    assert (report.n_markers, report.n_slides, report.n_drifted, report.in_sync, report.n_problems) == (2, 2, 1, 1, 0)
    with pytest.raises(cohort.MarkerMapError) as e:
        cohort.enforce(spark.createDataFrame([("DAPI", "DAPI", "RESOLVED"), ("x", "nope", "RESOLVED")], MAP), registry(spark), channels)
    assert {r.original_name: r.status for r in e.value.repaired.collect()} == {"DAPI": "RESOLVED", "x": "REVIEW"}
    with pytest.raises(ValueError, match="without a row"):
        cohort.enforce(good.where("original_name = 'DAPI'"), registry(spark), channels)
    with pytest.raises(ValueError, match="nuclear"):
        cohort.enforce(good, registry(spark), channels.where("raw = 'x'"))
    with pytest.raises(ValueError, match="fit no marker"):
        cohort.resolve_cohort_markers(channels, registry(spark), include=["nothing*"])
    kept, resolution = cohort.resolve_cohort_markers(channels.union(spark.createDataFrame([("s", 2, "Hoechst 1", "", "", True)], channels.schema)), registry(spark), extra=None)
    assert {r.original_name for r in kept.collect()} == {"DAPI", "x"} and {r.original_name: r["keep"] for r in resolution.collect()}["Hoechst 1"] is False


def test_families_and_layouts(spark):
    ch = spark.createDataFrame([("s", 0, "Hoechst1"), ("s", 1, "Pan-CK"), ("s", 2, "PanCKs"), ("s", 3, "EBNA1")], "slide_id string, channel_idx int, marker string")
    reg = spark.createDataFrame([("PanCK", "epithelial_keratin"), ("EBNA1", "qc_mask"), ("Hoechst", "cytoskeleton")], "marker_name string, family string")
    assert sorted(r.channel_idx for r in cohort.structural_by_family(ch, reg).collect()) == [1, 2]
    assert sorted(r.channel_idx for r in cohort.non_qc_channels(ch, reg).collect()) == [0, 1, 2]
    assert cohort.explicit_nuclear(ch, "hoechst1").first().nuclear_idx == 0
    with pytest.raises(Exception, match="no channel CD9"):
        cohort.explicit_nuclear(ch, "CD9").collect()
    planes = spark.createDataFrame([("a", "XYZ", 0, 1, 0, 1)], "slide_id string, axes string, page int, n_pages int, sample int, n_samples int")
    with pytest.raises(Exception, match="layouts known"):
        harmonize.harmonize(planes).collect()
    with pytest.raises(Exception, match="more than one file"):
        checks.artifact_of(spark.createDataFrame([("a.tif",)], "name string"), spark.createDataFrame([("a.csv",), ("a.txt",)], "file string")).collect()


def big_tiled(a, tile, predictor=1):
    """A BigTIFF of one zlib page in tiles."""
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    places, sizes = [], []
    for y in range(0, a.shape[0], tile):
        for x in range(0, a.shape[1], tile):
            part = np.zeros((tile, tile), a.dtype)
            own = a[y : y + tile, x : x + tile]
            part[: own.shape[0], : own.shape[1]] = own
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1) if predictor == 2 else part
            body = zlib.compress(part.astype("<u2").tobytes())
            places.append(len(out))
            sizes.append(len(body))
            out += body
    lists = len(out)
    out += struct.pack(f"<{len(places)}Q", *places) + struct.pack(f"<{len(sizes)}Q", *sizes)
    tags = [(256, 4, 1, a.shape[1]), (257, 4, 1, a.shape[0]), (258, 3, 1, 16), (259, 3, 1, 8), (277, 3, 1, 1), (317, 3, 1, predictor), (322, 3, 1, tile), (323, 3, 1, tile), (324, 16, len(places), lists), (325, 16, len(sizes), lists + 8 * len(places))]
    struct.pack_into("<Q", out, 8, len(out))
    out += struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0)
    return bytes(out)


def test_tiff_layouts_and_guards(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 60000, (50, 70)).astype(np.uint16)
    for predictor in (1, 2):
        page = next(images.tiff_pages(big_tiled(a, 32, predictor)))
        assert (np.frombuffer(page["data"], np.uint16).reshape(50, 70) == a).all()
    with pytest.raises(ValueError, match="predictor"):
        next(images.tiff_pages(big_tiled(a, 32, 3)))
    with pytest.raises(ValueError, match="not a TIFF"):
        next(images.tiff_pages(b"II" + struct.pack("<H", 41) + b"\0" * 20))
    for name, v in (("CD3.tif", a), ("CD20.tif", a + 1), ("DAPI.tif", a + 2)):
        (tmp_path / name).write_bytes(tiff([v]))
    rows = images.read_channel_dir(spark, str(tmp_path)).orderBy("channel_idx").collect()
    assert [(r.channel_idx, r.raw, r.mpp) for r in rows] == [(0, "CD20", 0.5), (1, "CD3", 0.5), (2, "DAPI", 0.5)] and bytes(rows[1].data) == a.tobytes()
    (tmp_path / "odd.tif").write_bytes(tiff([a[:10]]))
    with pytest.raises(ValueError, match="different sizes"):
        images.read_channel_dir(spark, str(tmp_path))


def test_otsu_of_small_values(spark):
    v = np.concatenate([np.random.default_rng(0).normal(10, 2, 400), np.random.default_rng(1).normal(40, 5, 200)])
    cut = lambda x: raster.otsu_threshold(spark.createDataFrame([("a", float(y)) for y in x], "k string, v double"), ["k"], "v").first().threshold
    assert np.isclose(cut(v * 2.0**-20), cut(v) * 2.0**-20)


def test_search_of_strength(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(i % 2 * 3, 1, 3)], i % 2, i % 2 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "cell_id long, x array<double>, y int, fold int")
    best, scores = learning.search_c(df.where("cell_id < 40"), df.where("cell_id >= 40"), "x", "y", [1e-3, 1.0])
    assert best in (1e-3, 1.0) and max(s for _, s in scores) > 0.8 and len(learning.c_grid()) == 15

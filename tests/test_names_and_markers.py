import pytest
from pyspark.sql import functions as F

from tilewright.functions import names as N
from tilewright.operators import markers


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s"))).first()[0]


@pytest.mark.parametrize(("raw", "key"), [("CD-8", "cd8"), ("CD_8", "cd8"), ("HLA-DR", "hladr"), ("CD8α(Opal650)", "cd8aopal650"), ("PD/L1", "pdl1"), (None, None)])
def test_key(spark, raw, key):
    assert one(spark, raw, N.normalize_key) == key


def test_slugs():
    assert N.slug("Immune Panel.v2") == "immune_panel_v2" and N.slug("---") == ""
    assert N.patch_slug(0.37, 256) == "0.37mpp_256px"
    assert N.patch_slug(0.5, 256, 0.5) == "0.5mpp_256px_0.5overlap"
    assert N.patch_slug(0.5, 64, 0.5, cell=True) == "cell_0.5mpp_64px"
    assert N.effective_stride(256, 0.5) == 128
    assert N.variant_name() == "markers_all"
    with pytest.raises(ValueError):
        N.variant_name("---")


@pytest.mark.parametrize(("dtype", "scale"), [("uint16", 65535), ("uint8", 255), (">u2", 65535), ("float32", 1)])
def test_scale(spark, dtype, scale):
    assert one(spark, dtype, N.scaling_factor) == scale


def test_scale_rejects(spark):
    with pytest.raises(Exception, match="not supported"):
        one(spark, "uint32", N.scaling_factor)


@pytest.mark.parametrize(("glob", "name", "fits"), [("cd*", "CD3", True), ("cd?", "CD3e", False), ("[!a]b", "ab", False), ("[!a]b", "cb", True), ("a.b", "axb", False)])
def test_globs(spark, glob, name, fits):
    assert one(spark, name, lambda c: N.matches_any(c, [glob])) is fits


def registry(spark):
    return spark.createDataFrame([("DAPI",), ("CD8",), ("CD4",), ("Vimentin",)], "marker_name string")


def test_map_promote_resolve(spark):
    names = spark.createDataFrame([("DAPI",), ("CD-8",), ("FancyX",), ("Hoechst1",), (None,)], "original_name string")
    got = {r.original_name: (r.mapped_canonical_name, r.status) for r in markers.build_marker_map(names, registry(spark)).collect()}
    assert got == {"DAPI": ("DAPI", "RESOLVED"), "CD-8": ("CD8", "RESOLVED"), "FancyX": ("", "REVIEW"), "Hoechst1": ("Hoechst1", "RESOLVED")}
    edited = spark.createDataFrame([("FancyX", "CD4", "REVIEW", "yes"), ("odd", "", "NOVEL", "no"), ("bad", "CD24", "RESOLVED", "yes")], "original_name string, mapped_canonical_name string, status string, keep_for_analysis string")
    assert {r.original_name: r.problem for r in markers.validate(edited, registry(spark)).collect()} == {"odd": "unresolved", "bad": "invalid"}
    resolved = {r.original_name: (r.marker, r.status, r.keep) for r in markers.resolve(markers.promote(edited, registry(spark))).collect()}
    assert resolved == {"FancyX": ("CD4", "RESOLVED", True), "odd": ("", "NOVEL", False), "bad": ("CD24", "RESOLVED", True)}


def test_suggestions(spark):
    out = markers.suggestions(spark.createDataFrame([("CD8a",)], "original_name string"), registry(spark), 2).first()
    assert out.suggestions[0] == "CD8"


def test_panel(spark):
    rows = [("s", 0, "DAPI", True), ("s", 1, "CD3", True), ("s", 2, "CD20", None), ("s", 3, "CD4", False)]
    ch = spark.createDataFrame(rows, "slide_id string, channel_idx int, marker string, keep boolean")
    assert [r.marker for r in markers.apply_panel(ch, ["dapi", "cd*"], ["cd20"]).orderBy("channel_idx").collect()] == ["DAPI", "CD3"]
    with pytest.raises(ValueError, match="fit no"):
        markers.apply_panel(ch, ["dapi", "cd4"])
    with pytest.raises(ValueError, match="nuclear"):
        markers.apply_panel(ch, ["cd*"])
    assert markers.nuclear_channel(ch).first().nuclear_idx == 0

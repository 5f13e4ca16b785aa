import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import colour, report, resolvers
from tilewright.plans import config


def test_patch_config():
    c = config.PatchConfig.of({"patch_size": 256, "overlap": 0.5})
    assert c.step == 128 and c.slug(0.37) == "0.37mpp_256px_0.5overlap"
    assert config.PatchConfig(64, mode="cell_centered").slug(0.5) == "cell_0.5mpp_64px"
    with pytest.raises(ValueError, match="unknown settings"):
        config.PatchConfig.of({"size": 1})
    with pytest.raises(ValueError):
        config.PatchConfig(256, stride=10, overlap=0.5)
    assert config.PatchConfig(target_mpp=0.5004).resolve_mpp(0.5) == 0.5
    with pytest.raises(NotImplementedError):
        config.PatchConfig(target_mpp=1.0).resolve_mpp(0.5)
    with pytest.raises(ValueError, match="finer"):
        config.PatchConfig(target_mpp=0.2).resolve_mpp(0.5)


def test_subset(spark):
    pytest.importorskip("yaml")
    s = config.Subset.from_yaml("name: Immune Panel.v2\nchannels: {include: ['cd*', DAPI], exclude: [CD4]}\nimages: {include: [a, b, zz], exclude: [b]}")
    assert s.variant == "markers_immune_panel_v2"
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert [r.name for r in s.select_images(images).collect()] == ["a"] and [r.name for r in s.unmatched_images(images).collect()] == ["zz"]
    ch = spark.createDataFrame([("CD3",), ("CD4",), ("dapi",), ("x",)], "marker string")
    assert {r.marker for r in s.select_channels(ch).collect()} == {"CD3", "dapi"}


def test_ledger(spark, tmp_path):
    with config.run_ledger(str(tmp_path), "patch", {"size": 2}):
        pass
    with pytest.raises(KeyError), config.run_ledger(str(tmp_path), "tissue", {}):
        raise KeyError("x")
    (tmp_path / "bad.json").write_text("{oops")
    rows = {r.tool: r for r in config.read_runs(spark, str(tmp_path)).collect()}
    assert rows["patch"].status == "completed" and rows["patch"].args == {"size": "2"}
    assert rows["tissue"].status == "error" and "KeyError" in rows["tissue"].error and rows[None].unreadable


def test_resolvers(spark):
    vocab = spark.createDataFrame([("dapi",), ("cd8",), ("cytokeratin",)], "marker string")
    alias = spark.createDataFrame([("panck", "cytokeratin"), ("hoechst1", "dapi")], "name string, target string")
    names = spark.createDataFrame([("CD-8",), ("CD8",), ("PanCK",), ("Hoechst1",), ("x_CD8",), ("cytokeratins",), ("unheard",)], "name string")
    got = {r.name: (r.target, r.step) for r in resolvers.resolve_names(names, vocab, alias).collect()}
    assert got["CD8"] == ("cd8", "exact") and got["PanCK"] == ("cytokeratin", "alias") and got["Hoechst1"] == ("dapi", "alias")
    assert got["x_CD8"] == ("cd8", "part") and got["cytokeratins"] == ("cytokeratin", "close") and got["unheard"] == ("unheard", "cleaned")
    genes = spark.createDataFrame([("CD3", "CD3e"), ("HLA-DR", "HLADRA")], "name string, target string")
    ch = spark.createDataFrame([(0, "Hoechst1"), (1, "cd3"), (2, "HLA DR"), (3, "hladr"), (4, "zz")], "channel_idx int, name string")
    assert [(r.gene, r.state) for r in resolvers.resolve_genes(ch, genes).orderBy("channel_idx").collect()] == [(None, "skipped"), ("CD3e", "kept"), ("HLADRA", "kept"), ("HLADRA", "kept"), (None, "dropped")]


def test_report(spark):
    assert spark.range(1).select(report.nice_length(F.lit(170.0)).alias("n")).first().n == 200
    rows = spark.range(100).select(F.lit("s").alias("k"), F.col("id"))
    assert [r.id for r in report.evenly_spaced(rows, ["k"], "id", 12).orderBy("id").collect()] == sorted(set(np.linspace(0, 99, 12).astype(int).tolist()))
    boxes = spark.createDataFrame([("s", 0, 0, 0, 1), ("s", 1, 0, 0, 2), ("s", 2, 9, 0, 3)], "slide_id string, patch_idx long, x int, y int, cluster int")
    assert {(r.cy, r.cx): r.cluster for r in report.cluster_map(boxes, 4).collect()} == {(0, 0): 2, (0, 2): 3}


def test_resample(spark):
    a = np.arange(64, dtype=np.uint16).reshape(8, 8)
    t = spark.createDataFrame([("s", 8, 8, "uint16", bytearray(a.tobytes()))], "slide_id string, h int, w int, dtype string, data binary")
    r = colour.resample(t, 2.0).first()
    got = np.frombuffer(r.data, np.uint16).reshape(r.h, r.w)
    assert np.allclose(got, a.reshape(4, 2, 4, 2).mean((1, 3)), atol=1)
    with pytest.raises(ValueError):
        colour.resample(t, 0.5)


def test_composite(spark):
    px = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 4.0), (1, 0, 0, 5.0), (1, 0, 1, 5.0)], "channel_idx int, y int, x int, v double")
    colours = spark.createDataFrame([(0, 1.0, 0.0, 0.25), (1, 0.0, 1.0, 0.0)], "channel_idx int, r double, g double, b double")
    got = {r.x: (r.r, r.g, r.b) for r in colour.min_max_composite(px, colours).collect()}
    assert got == {0: (0, 0, 0), 1: (255, 0, 127)}

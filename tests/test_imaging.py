import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import cells, features, learning, metrics, morphology, raster, spatial, stats
from tilewright.plans import workflow


def runs_of(mask, slide="s"):
    return [(slide, int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(mask))]


def mask_of(rows, shape):
    out = np.zeros(shape, bool)
    for r in rows:
        out[r.y, r.x_start : r.x_end] = True
    return out


RUNS = "slide_id string, y int, x_start int, x_end int"


def test_grid_and_fraction(spark):
    slide = spark.createDataFrame([("s", 64, 64), ("t", 10, 10)], "slide_id string, height int, width int")
    g = spatial.grid(slide, 32, 32)
    assert [(r.x, r.y) for r in g.orderBy("patch_idx").collect()] == [(0, 0), (32, 0), (0, 32), (32, 32)]
    runs = spark.createDataFrame([("s", y, 0, 32) for y in range(32)], RUNS)
    assert [r.tissue_prop for r in spatial.tissue_fraction(g, runs, 32).orderBy("patch_idx").collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fraction_brute(spark):
    rng = np.random.default_rng(1)
    mask = rng.random((60, 70)) > 0.6
    runs = morphology.merge_runs(spark.createDataFrame(runs_of(mask), RUNS))
    slide = spark.createDataFrame([("s", 60, 70)], "slide_id string, height int, width int")
    for r in spatial.tissue_fraction(spatial.grid(slide, 16, 12), runs, 16).collect():
        assert math.isclose(r.tissue_prop, mask[r.y : r.y + 16, r.x : r.x + 16].mean(), rel_tol=1e-6)


def test_boxes_and_rounding(spark):
    df = spark.createDataFrame([(7, 50.0, 40.0), (9, 1.0, 1.0), (3, 0.5, 1.5)], "id int, x double, y double")
    got = {r.id: (r.bx, r.by) for r in df.select("id", spatial.box_origin(F.col("x"), 16).alias("bx"), spatial.box_origin(F.col("y"), 16).alias("by")).collect()}
    assert got == {7: (42, 32), 9: (-7, -7), 3: (-8, -6)}


def test_mean_marker(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, 4), (1, 0), (2, 0)], "p int, v int")
    got = {r.p: r.feature for r in features.mean_marker(df, ["p"], scale=65535.0).collect()}
    assert round(got[1] * 65535, 3) == 3.0 and got[2] == 0


def test_pooled(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 2.0), ("a", "m", 3.0), ("b", "m", 5.0), ("b", "m", 9.0), ("a", "one", 4.0)], "slide_id string, marker string, v double")
    got = {r.marker: r for r in stats.pool(stats.slide_partials(df)).collect()}
    assert math.isclose(got["m"].mean, 4) and math.isclose(got["m"]["std"], np.std([1, 2, 3, 5, 9], ddof=1)) and got["one"]["std"] == 0


def test_otsu(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(10, 2, 400), rng.normal(40, 5, 200)])
    got = raster.otsu_threshold(spark.createDataFrame([("a", float(x)) for x in v], "k string, v double"), ["k"], "v").first().threshold
    n, edges = np.histogram(v, 256)
    c = (edges[1:] + edges[:-1]) / 2
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1, m2 = np.cumsum(n * c) / w1, (np.cumsum((n * c)[::-1]) / w2[::-1])[::-1]
    assert math.isclose(got, c[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)], rel_tol=1e-9)


def test_downsample(spark):
    df = spark.createDataFrame([(y, x, 0 if x < 2 else 4) for y in range(2) for x in range(4)], "y int, x int, v int")
    assert sorted((r.y, r.x, r.v) for r in raster.box_downsample(df, 2).collect()) == [(0, 0, 0), (0, 1, 4)]


def test_centroids_and_relabel(spark):
    runs = spark.createDataFrame([("s", 2, 2, 4, 7), ("s", 3, 2, 4, 7), ("s", 9, 0, 1, 9)], RUNS + ", cell_id int")
    got = {r.cell_id: (r.x, r.y, r.cell_area) for r in cells.centroids_of_runs(runs).collect()}
    assert got == {7: (2.5, 2.5, 4), 9: (0.0, 9.0, 1)}
    assert {r.cell_id: r.new_id for r in cells.relabel(cells.centroids_of_runs(runs), ["slide_id"]).collect()} == {7: 1, 9: 2}


@pytest.mark.parametrize(("connectivity", "n"), [(4, 3), (8, 2)])
def test_components(spark, connectivity, n):
    runs = spark.createDataFrame([("s", 0, 0, 3), ("s", 1, 3, 5), ("s", 2, 4, 6), ("s", 0, 8, 9), ("t", 1, 3, 5)], RUNS)
    sizes = morphology.component_sizes(morphology.components(runs, connectivity)).where("slide_id = 's'")
    assert sizes.count() == n and sizes.agg(F.sum("area")).first()[0] == 8


def test_fill_and_closing(spark):
    mask = np.zeros((12, 14), bool)
    mask[2:9, 2:9] = True
    mask[4:6, 4:6] = False
    mask[2:9, 11] = True
    slide = spark.createDataFrame([("s", 12, 14)], "slide_id string, height int, width int")
    runs = morphology.merge_runs(spark.createDataFrame(runs_of(mask), RUNS))
    filled = mask.copy()
    filled[4:6, 4:6] = True
    assert (mask_of(morphology.fill_holes(runs, slide, 4).collect(), mask.shape) == filled).all()
    assert (mask_of(morphology.fill_holes(runs, slide, 3).collect(), mask.shape) == mask).all()
    r = 2
    pad = np.pad(mask, r)
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]
    grown = np.zeros_like(np.pad(pad, r))
    for dy, dx in offsets:
        grown[r + dy : r + dy + pad.shape[0], r + dx : r + dx + pad.shape[1]] |= pad
    shrunk = np.ones_like(pad)
    for dy, dx in offsets:
        shrunk &= grown[r + dy : r + dy + pad.shape[0], r + dx : r + dx + pad.shape[1]]
    assert (mask_of(morphology.closing(runs, slide, r).collect(), mask.shape) == shrunk[r:-r, r:-r]).all()


def test_rasterize(spark):
    ring = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    polys = spark.createDataFrame([("s", [ring(1, 9), ring(3, 5)])], "slide_id string, rings array<array<struct<x:double,y:double>>>")
    want = np.zeros((10, 10), bool)
    want[1:9, 1:9] = True
    want[3:5, 3:5] = False
    assert (mask_of(morphology.rasterize(polys).collect(), want.shape) == want).all()
    assert morphology.geometry_hash(polys).count() == 1


def test_hull(spark):
    pts = spark.createDataFrame([("s", float(x), float(y)) for x in range(5) for y in range(5)], "slide_id string, x double, y double")
    ring = morphology.convex_hulls(pts).first().ring
    assert {(p.x, p.y) for p in ring} == {(0, 0), (4, 0), (4, 4), (0, 4)}


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, y_hat string")
    s = metrics.summary(rows).first()
    assert math.isclose(s.macro_f1, (2 / 3 + 0.5 + 0) / 3) and math.isclose(s.balanced_accuracy, 0.5)
    sc = spark.createDataFrame([("k", True, 0.9), ("k", False, 0.9), ("k", True, 0.5), ("k", False, 0.1)], "label string, is_true boolean, score double")
    assert math.isclose(metrics.ovr_auc(sc).first().auc, 0.625)
    assert math.isclose(metrics.average_precision(sc).first().average_precision, 0.5 * 0.5 + 0.5 * 2 / 3)


def test_knn_is_exact(spark):
    v = np.random.default_rng(2).standard_normal((40, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    for r in learning.knn(df, 3, "id", "v").collect():
        d = np.sqrt(((v - v[r.id]) ** 2).sum(1))
        d[r.id] = np.inf
        assert np.argsort(d, kind="stable")[r["rank"] - 1] == r.neighbour


def brute_nearest(ids, v, k):
    """{id: its k nearest others}, smallest id of equals, among finite vectors."""
    own = [(i, np.array(x, float)) for i, x in zip(ids, v) if x is not None and None not in x and np.isfinite(x).all()]
    out = {}
    for i, x in own:
        out[i] = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in own if j != i)[:k]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_knn_in_passes_with_copies_and_broken_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(learning, "VECTORS", 1024)
    v = [[float(x) for x in r] for r in np.random.default_rng(3).integers(-2, 3, (150, 4))]  # many copies and ties
    v[20:50] = [v[20]] * 30
    v[5], v[6], v[7], v[8] = None, [1.0, math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [0.0, None, 0.0, 0.0]
    ids = [int(i) for i in np.random.default_rng(4).permutation(150)]
    got = {}
    for r in learning.knn(spark.createDataFrame(list(zip(ids, v)), f"id long, v array<{kind}>"), 5, "id", "v").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
        assert r["rank"] == len(got[r.id])
    assert got == brute_nearest(ids, v, 5)


def test_knn_blocks(monkeypatch):
    for name, value in (("ROWS", 7), ("OTHERS", 11), ("PAIRS", 13)):
        monkeypatch.setattr(learning, name, value)
    v = np.random.default_rng(5).standard_normal((60, 3))
    v[30:45] = v[30] * (1 + 1e-15)
    v += 1e4  # differences far smaller than the norms
    near, far = np.full((60, 4), -1), np.full((60, 4), np.inf)
    learning._nearest(np.arange(60), v, np.arange(60), v, near, far)
    assert {i: list(zip(far[i], near[i])) for i in range(60)} == brute_nearest(range(60), v.tolist(), 4)


def test_knn_of_few_or_uneven(spark):
    few = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, v array<double>")
    assert sorted(map(tuple, learning.knn(few, 3, "id", "v").collect())) == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]
    assert learning.knn(few.where("id > 2"), 3, "id", "v").count() == 0
    with pytest.raises(ValueError, match="1 to 2 components"):
        learning.knn(few.unionByName(spark.createDataFrame([(3, [0.0, 1.0])], "id long, v array<double>")), 3, "id", "v")


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_knn_shuffles_no_more_than_its_vectors(spark):
    v = np.random.default_rng(6).standard_normal((9000, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        learning.knn(df, 3, "id", "v").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 1.5 * v.nbytes


def test_label_propagation_makes_links_once(spark):
    rng = np.random.default_rng(7)
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a != b})
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(links, "id long, neighbour long").mapInArrow(count, "id long, neighbour long")
    got = dict(map(tuple, learning.label_propagation(edges, rounds=4).collect()))
    met = {}
    for a, b in links:
        met.setdefault(a, set()).add(b)
        met.setdefault(b, set()).add(a)
    want = {u: u for u in met}
    for _ in range(4):
        want = {u: min(((-sum(want[v] == c for v in vs), c) for c in {want[v] for v in vs}))[1] for u, vs in met.items()}
    assert got == want
    assert made.value == len(links)


def test_workflow(spark):
    t = spark.createDataFrame([("s", "a", "completed", None), ("s", "b", "error", "boom"), ("t", "a", "completed", None), ("u", "a", "skipped", None)], "slide string, key string, status string, error string")
    got = {r.slide: (r.status, r.first_error) for r in workflow.stage_collapse(t, ["slide"]).collect()}
    assert got == {"s": ("error", "boom"), "t": ("completed", None), "u": ("pending", None)}
    d = workflow.durations(spark.createDataFrame([("2024-01-01T10:00:00+00:00", "2024-01-01T10:00:42+00:00"), (None, "2024-01-01T10:00:42+00:00")], "started_at string, completed_at string"))
    assert [r.duration_s for r in d.collect()] == [42, None]


def tiff(pages, description=""):
    """A little-endian TIFF of uncompressed uint16 pages."""
    out, links = bytearray(b"II*\0\0\0\0\0"), [4]
    for a in pages:
        data_at = len(out)
        out += a.astype("<u2").tobytes()
        text = description.encode() + b"\0"
        text_at = len(out)
        out += text
        res_at = len(out)
        out += struct.pack("<II", 20000, 1)
        tags = [(256, 4, 1, a.shape[1]), (257, 4, 1, a.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (270, 2, len(text), text_at), (273, 4, 1, data_at), (277, 3, 1, 1), (278, 4, 1, a.shape[0]), (279, 4, 1, a.nbytes), (282, 5, 1, res_at), (296, 3, 1, 3)]
        struct.pack_into("<I", out, links[-1], len(out))
        out += struct.pack("<H", len(tags))
        for t, k, n, v in tags:
            out += struct.pack("<HHII", t, k, n, v)
        links.append(len(out))
        out += b"\0\0\0\0"
    return bytes(out)


def test_tiff_to_pixels(spark, tmp_path):
    from tilewright.sources import images

    a = np.arange(24, dtype=np.uint16).reshape(4, 6)
    (tmp_path / "x.ome.tiff").write_bytes(tiff([a, a * 2]))
    pages = images.read_tiff(spark, str(tmp_path))
    rows = pages.orderBy("page").collect()
    assert len(rows) == 2 and rows[0].mpp == 0.5 and rows[1].dtype == "uint16"
    tiled = images.tiles(pages.select(F.col("file").alias("slide_id"), F.col("page").alias("channel_idx"), "height", "width", "dtype", "data"), 3)
    px = images.pixels(tiled, nonzero=True)
    assert px.where("channel_idx = 1").agg(F.sum("v")).first()[0] == 2 * a.sum() and px.count() == 46
    got = {(r.y, r.x): r.v for r in px.where("channel_idx = 0").collect()}
    assert got[(3, 5)] == 23
    names, mpp = images.ome_metadata('<OME xmlns="u"><Image><Pixels PhysicalSizeX="500" PhysicalSizeXUnit="nm"><Channel Name="DAPI"/><Channel ID="c:1"/></Pixels></Image></OME>')
    assert names == ["DAPI", "c:1"] and mpp == 0.5


def test_geojson_and_csv(spark, tmp_path):
    from tilewright.sources import tables

    p = tmp_path / "a.geojson"
    p.write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}},{"geometry":{"type":"Point","coordinates":[1,2]}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]],[[[7,7],[8,7],[8,8],[7,7]]]]}}]}')
    rows = tables.read_geojson(spark, str(p)).orderBy("tissue_id").collect()
    assert [r.rings[0][0].x for r in rows] == [0, 5, 7]
    c = tmp_path / "map.csv"
    c.write_text("original_name,status\n# skipped\nDAPI,\n007,NOVEL\n")
    got = tables.read_marker_map(spark, str(c)).collect()
    assert [(r.original_name, r.status, r.suggestion_1) for r in got] == [("DAPI", "", ""), ("007", "NOVEL", "")]
    n = tmp_path / "names.txt"
    n.write_text(" DAPI \n\nCD3\n")
    assert [(r.channel_idx, r.raw) for r in tables.read_channel_names(spark, str(n)).collect()] == [(0, "DAPI"), (1, "CD3")]


def test_stream_merges_once(spark, tmp_path):
    from tilewright.streaming import partials

    schema = "slide_id string, marker string, v double"
    for batch in ([("a", "m", 1.0), ("a", "m", 2.0)], [("b", "m", 6.0)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        partials.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    got = partials.pooled(spark, str(tmp_path / "store")).first()
    assert got.n == 3 and math.isclose(got["mean"], 3) and math.isclose(got["std"], np.std([1, 2, 6], ddof=1))

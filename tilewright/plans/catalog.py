"""All queries of the imaging operators by name, over the driver's tables, with their DuckDB twins.

Tables stand in for imaging data: ``events`` for intensities by slide (user) and marker
(type), ``lineitem`` and ``part`` for pixels and points, ``orders`` for task states,
``embeddings`` for per-patch features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import cells, checks, cohort, colour, features, harmonize, learning, markers, metrics, morphology, raster, report, resolvers, spatial, stats
from . import workflow

FLAGSHIP = "mean_marker"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _intensity(spark: SparkSession, d: str) -> DataFrame:
    """Events as pixels: values under 20 count as background."""
    return _t(spark, d, "events").select(F.col("user_id").alias("slide_id"), F.col("event_type").alias("marker"), F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")).alias("v"))


@_query("""SELECT user_id % 50 AS patch_idx, event_type AS marker,
  round(sum(CASE WHEN value < 20 THEN 0 ELSE value END) / (1e-6 + count(*) FILTER (WHERE value >= 20)), 6) AS feature
  FROM events GROUP BY 1, 2""")
def mean_marker(spark, d):
    px = _intensity(spark, d).withColumn("patch_idx", F.col("slide_id") % 50)
    return features.mean_marker(px, ["patch_idx", "marker"]).withColumn("feature", F.round("feature", 6))


@_query("""SELECT user_id AS slide_id, event_type AS marker, count(value) AS n_pixels, round(avg(value), 6) AS mean,
  round(coalesce(var_samp(value), 0), 6) AS var FROM events GROUP BY 1, 2""")
def slide_partial_stats(spark, d):
    px = _t(spark, d, "events").select(F.col("user_id").alias("slide_id"), F.col("event_type").alias("marker"), F.col("value").alias("v"))
    return stats.slide_partials(px).withColumns({"mean": F.round("mean", 6), "var": F.round("var", 6)})


@_query("SELECT event_type AS marker, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def pooled_marker_stats(spark, d):
    px = _t(spark, d, "events").select(F.col("user_id").alias("slide_id"), F.col("event_type").alias("marker"), F.col("value").alias("v"))
    return stats.pool(stats.slide_partials(px)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("SELECT event_type AS marker, round(quantile_cont(value, 0.01), 6) AS lo, round(quantile_cont(value, 0.99), 6) AS hi FROM events GROUP BY 1")
def percentile_bounds(spark, d):
    out = raster.percentile_bounds(_t(spark, d, "events").withColumnRenamed("event_type", "marker"), ["marker"], "value")
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@_query("""WITH b AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
  SELECT event_id, round(CASE WHEN hi <= lo THEN 0 ELSE greatest(0, least(1, (value - lo) / (hi - lo))) END, 6) AS share
  FROM events JOIN b USING (event_type)""")
def percentile_stretch(spark, d):
    e = _t(spark, d, "events")
    b = raster.percentile_bounds(e, ["event_type"], "value")
    return e.join(b, "event_type").select("event_id", F.round(raster.stretch(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("share"))


@_query("""WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
  h AS (SELECT l.l_returnflag, lo, hi, least(255, floor((l_extendedprice - lo) / ((hi - lo) / 256)))::INT AS bin, count(*) AS n
    FROM lineitem l JOIN b ON l.l_returnflag = b.l_returnflag GROUP BY ALL),
  c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS centre FROM h),
  w AS (SELECT *, sum(n) OVER u AS n1, sum(n * bin) OVER u AS s1, sum(n) OVER g AS nn, sum(n * bin) OVER g AS ss FROM c
    WINDOW u AS (PARTITION BY l_returnflag ORDER BY bin ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY l_returnflag)),
  v AS (SELECT l_returnflag, bin, centre, CASE WHEN n1 < nn THEN (s1 * nn - ss * n1)::DOUBLE * (s1 * nn - ss * n1)::DOUBLE / (n1 * (nn - n1))::DOUBLE ELSE 0 END AS q FROM w)
  SELECT l_returnflag, round(centre, 6) AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, bin) = 1""")
def otsu_threshold(spark, d):
    return raster.otsu_threshold(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumn("threshold", F.round("threshold", 6))


@_query("""WITH s AS (SELECT p_partkey AS slide_id, p_size * 40 + 200 AS width, p_size * 30 + 250 AS height FROM part),
  g AS (SELECT slide_id, width, height, CASE WHEN width < 256 THEN [] ELSE list_sort(list_distinct(list_append(range(0, width - 256 + 1, 200), width - 256))) END AS xs,
    CASE WHEN height < 256 THEN [] ELSE list_sort(list_distinct(list_append(range(0, height - 256 + 1, 200), height - 256))) END AS ys FROM s)
  SELECT slide_id, ((i - 1) * len(xs) + (j - 1))::BIGINT AS patch_idx, xs[j]::BIGINT AS x, ys[i]::BIGINT AS y
  FROM g, unnest(range(1, len(ys) + 1)) a(i), unnest(range(1, len(xs) + 1)) b(j)""")
def grid_edge_cover(spark, d):
    s = _t(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 40 + 200).alias("width"), (F.col("p_size") * 30 + 250).alias("height"))
    return spatial.grid(s, 256, 200)


@_query("""WITH p AS (SELECT * FROM (SELECT unnest(range(0, 8)) AS gx), (SELECT unnest(range(0, 8)) AS gy)),
  b AS (SELECT (gy * 8 + gx)::BIGINT AS patch_idx, gx * 200 AS x, gy * 200 AS y FROM p),
  r AS (SELECT p_partkey % 1656 AS ry, (p_size * 20)::BIGINT AS xs, min(p_size * 20 + p_retailprice::BIGINT % 300 + 1)::BIGINT AS xe FROM part GROUP BY ALL),
  m AS (SELECT ry, unnest(range(xs, xe)) AS px FROM r),
  u AS (SELECT DISTINCT ry, px FROM m)
  SELECT patch_idx, (count(px)::DOUBLE / 65536)::FLOAT AS tissue_prop FROM b LEFT JOIN u ON ry >= y AND ry < y + 256 AND px >= x AND px < x + 256 GROUP BY 1""")
def grid_tissue_fraction(spark, d):
    part = _t(spark, d, "part").select((F.col("p_partkey") % 1656).alias("y"), (F.col("p_size") * 20).cast("bigint").alias("x_start"), (F.col("p_size") * 20 + F.rint("p_retailprice").cast("bigint") % 300 + 1).alias("x_end"))
    runs = part.groupBy("y", "x_start").agg(F.min("x_end").alias("x_end")).withColumn("slide_id", F.lit("s"))
    runs = morphology.merge_runs(runs)
    slide = spark.range(1).select(F.lit("s").alias("slide_id"), F.lit(1656).alias("width"), F.lit(1656).alias("height"))
    return spatial.tissue_fraction(spatial.grid(slide, 256, 200), runs, 256).select("patch_idx", "tissue_prop")


@_query("SELECT event_id, (round_even(value, 0) - 8)::BIGINT AS x, (round_even(value / 2, 0) - 8)::BIGINT AS y FROM events")
def cell_boxes(spark, d):
    return _t(spark, d, "events").select("event_id", spatial.box_origin(F.col("value"), 16).alias("x"), spatial.box_origin(F.col("value") / 2, 16).alias("y"))


_BOXES = """b AS (SELECT (s_suppkey)::BIGINT AS patch_idx, (s_suppkey * 37 % 1500)::BIGINT AS x, (s_suppkey * 11 % 60)::BIGINT AS y FROM supplier)"""


@_query(f"""WITH {_BOXES} SELECT patch_idx, count(*) AS n, round(sum(l_quantity) / (1e-6 + count(*) FILTER (WHERE l_quantity <> 0)), 6) AS feature
  FROM b JOIN lineitem ON l_partkey >= x AND l_partkey < x + 64 AND l_suppkey >= y AND l_suppkey < y + 64 GROUP BY 1""")
def pixel_box_mean(spark, d):
    s = F.col("s_suppkey")
    boxes = _t(spark, d, "supplier").select(s.alias("patch_idx"), (s * 37 % 1500).alias("x"), (s * 11 % 60).alias("y"))
    points = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("px"), F.col("l_suppkey").alias("py"), F.col("l_quantity").alias("v"))
    return spatial.box_points(boxes, points, 64).groupBy("patch_idx").agg(F.count(F.lit(1)).alias("n"), F.round(features.nonzero_mean(F.col("v")), 6).alias("feature"))


@_query("""WITH p AS (SELECT (l_suppkey)::BIGINT AS y, (l_partkey % 100)::BIGINT AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
  r AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING) AS s FROM p)
  SELECT y, x, round(sum(s) OVER (PARTITION BY x ORDER BY y ROWS UNBOUNDED PRECEDING), 4) AS total FROM r""")
def integral_image(spark, d):
    px = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 100).alias("x")).agg(F.sum("l_quantity").alias("v"))
    return raster.integral_image(px).select("y", "x", F.round("total", 4).alias("total"))


@_query("SELECT l_suppkey, round(avg(l_partkey), 6) AS x, round(avg(l_orderkey), 6) AS y, count(*) AS cell_area FROM lineitem GROUP BY 1")
def centroids(spark, d):
    out = cells.centroids(_t(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", "l_orderkey")
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@_query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS new_id FROM customer WHERE c_acctbal > 0")
def restrict_relabel(spark, d):
    return cells.relabel(_t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey")


@_query("SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1")
def max_projection(spark, d):
    return raster.max_projection(_t(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice")


@_query("SELECT l_orderkey, round(sum(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1")
def composite_sum(spark, d):
    return raster.composite_sum(_t(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice").withColumn("v", F.round("v", 4))


@_query("""WITH p AS (SELECT l_suppkey AS y, l_partkey % 20 AS x, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
  SELECT (y // 4)::BIGINT AS y, (x // 4)::BIGINT AS x, floor(avg(v))::BIGINT AS v FROM p GROUP BY 1, 2 HAVING count(*) = 16""")
def box_downsample(spark, d):
    px = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 20).alias("x")).agg(F.max("l_quantity").alias("v"))
    return raster.box_downsample(px, 4)


def _label_sets(spark, d):
    lab = _t(spark, d, "labels")
    return lab.select("doc_id", F.lit("quality").alias("label_set"), F.col("quality").cast("string").alias("label")).unionByName(lab.select("doc_id", F.lit("toxic").alias("label_set"), F.col("toxic").cast("string").alias("label")))


@_query("SELECT d.doc_id, d.lang, l.quality::VARCHAR AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_attach_left(spark, d):
    return features.with_labels(_t(spark, d, "documents").select("doc_id", "lang"), _label_sets(spark, d), "quality", "doc_id")


@_query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def label_semi(spark, d):
    return cells.labels_known(_t(spark, d, "labels").select("doc_id", "quality"), _t(spark, d, "documents").where("lang = 'en'"), "doc_id")


@_query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def label_anti(spark, d):
    return cells.labels_unknown(_t(spark, d, "labels").select("doc_id", "quality"), _t(spark, d, "documents").where("lang = 'en'"), "doc_id")


@_query("""SELECT doc_id, 'quality' AS label_set, quality::VARCHAR AS label FROM labels
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END FROM documents""")
def label_set_replace(spark, d):
    new = _t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "a").otherwise("b").alias("label"))
    return cells.replace_label_set(_label_sets(spark, d), new, "toxic")


@_query("SELECT d.doc_id, coalesce(l.quality::DOUBLE, d.n_chars::DOUBLE) AS mpp FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) > 0")
def override_coalesce(spark, d):
    slides = _t(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").cast("double").alias("mpp"))
    table = _t(spark, d, "labels").select(F.col("doc_id").alias("image"), F.col("quality").cast("double").alias("mpp"))
    slides = slides.join(table.where("mpp = 0").select(F.col("image").alias("name")), "name", "left_anti")
    return workflow.resolve_mpp(slides, table).select(F.col("name").alias("doc_id"), "mpp")


_KEY = "replace(regexp_replace(translate(lower({0}), '- :()α/', '_____a'), '^\\s+|\\s+$', '', 'g'), '_', '')"


@_query(f"SELECT p_partkey, {_KEY.format('p_brand')} AS brand_key, {_KEY.format('p_name')} AS name_key FROM part")
def marker_key(spark, d):
    return _t(spark, d, "part").select("p_partkey", N.normalize_key(F.col("p_brand")).alias("brand_key"), N.normalize_key(F.col("p_name")).alias("name_key"))


def _registry(spark, d):
    """A registry of the names of parts of even size, spelt another way."""
    p = _t(spark, d, "part").where("p_size % 2 = 0").select(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("marker_name"))
    return p.distinct()


_REGISTRY = f"""reg AS (SELECT min(n) AS marker_name, k FROM (SELECT upper(replace(p_name, ' ', '-')) AS n, {_KEY.format("upper(replace(p_name, ' ', '-'))")} AS k FROM part WHERE p_size % 2 = 0) GROUP BY k)"""


@_query(f"""WITH {_REGISTRY} SELECT p_partkey, p_name AS original_name, coalesce(marker_name, '') AS mapped_canonical_name,
  CASE WHEN marker_name IS NULL THEN 'REVIEW' ELSE 'RESOLVED' END AS status FROM part LEFT JOIN reg ON k = {_KEY.format('p_name')}""")
def marker_match(spark, d):
    return markers.match_markers(_t(spark, d, "part").select("p_partkey", F.col("p_name").alias("original_name")), _registry(spark, d))


@_query(f"""WITH {_REGISTRY}, m AS (SELECT DISTINCT p_name FROM part)
  SELECT CASE WHEN marker_name IS NULL THEN 'REVIEW' ELSE 'RESOLVED' END AS status, count(*) AS n FROM m LEFT JOIN reg ON k = {_KEY.format('p_name')} GROUP BY 1""")
def marker_map_status(spark, d):
    names = _t(spark, d, "part").select(F.col("p_name").alias("original_name"))
    return markers.build_marker_map(names, _registry(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_REGISTRY}, m AS (SELECT DISTINCT p_name AS original_name, upper(replace(p_name, ' ', '-')) AS mapped FROM part)
  SELECT original_name, mapped AS mapped_canonical_name, CASE WHEN mapped IN (SELECT upper(replace(p_name, ' ', '-')) FROM part WHERE p_size % 2 = 0) THEN 'RESOLVED' ELSE 'REVIEW' END AS status FROM m""")
def marker_promote(spark, d):
    m = _t(spark, d, "part").select(F.col("p_name").alias("original_name")).distinct().select("original_name", F.upper(F.replace(F.col("original_name"), F.lit(" "), F.lit("-"))).alias("mapped_canonical_name"), F.lit("REVIEW").alias("status"))
    return markers.promote(m, _registry(spark, d))


@_query("SELECT p_partkey, p_type FROM part WHERE p_name ILIKE '%a%' AND NOT (p_type ILIKE 's%' AND length(p_type) >= 1)")
def panel_glob(spark, d):
    p = _t(spark, d, "part")
    return p.where(N.matches_any(F.col("p_name"), ["*A*"]) & ~N.matches_any(F.col("p_type"), ["S*"])).select("p_partkey", "p_type")


@_query(f"SELECT p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY {_KEY.format('p_type')} ORDER BY p_partkey) = 1")
def registry_first_wins(spark, d):
    return markers.first_wins(_t(spark, d, "part").select("p_partkey", "p_type"), N.normalize_key(F.col("p_type")), F.col("p_partkey"))


@_query("""WITH m AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 103 + n_nationkey * 2 END AS id FROM nation),
  f AS (SELECT r.n_regionkey, o, row_number() OVER (PARTITION BY r.n_regionkey ORDER BY o) AS k FROM (SELECT DISTINCT n_regionkey FROM m) r, unnest(range(103, 256, 2)) t(o)
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.n_regionkey = r.n_regionkey AND m.id = o)),
  q AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM m WHERE id IS NULL)
  SELECT q.n_regionkey AS slide_id, q.n_nationkey AS channel_idx, f.o::INT AS marker_id FROM q JOIN f ON q.n_regionkey = f.n_regionkey AND q.k = f.k
  UNION ALL SELECT n_regionkey, n_nationkey, id::INT FROM m WHERE id IS NOT NULL""")
def odd_id_allocation(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_regionkey").alias("slide_id"), F.col("n_nationkey").alias("channel_idx"), F.col("n_name").alias("marker"), F.when(F.col("n_nationkey") % 3 == 0, 103 + F.col("n_nationkey") * 2).alias("marker_id"))
    return markers.odd_ids(n).drop("marker")


@_query("""WITH h AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 95) SELECT u.user_id AS slide_id, t.event_type AS marker
  FROM (SELECT DISTINCT user_id FROM h) u, (SELECT DISTINCT event_type FROM h) t EXCEPT SELECT user_id, event_type FROM h""")
def hetero_channels(spark, d):
    return markers.heterogeneous(_t(spark, d, "events").where("value > 95").select(F.col("user_id").alias("slide_id"), F.col("event_type").alias("marker")))


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def drift_missing(spark, d):
    return workflow.missing_outputs(_t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def drift_orphan(spark, d):
    return workflow.orphans(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def _tasks(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", status.alias("status"))


_TASKS = "t AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'error' END AS status FROM orders)"
_COLLAPSE = "count(*) AS n_tasks, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'pending' END AS status"


@_query(f"WITH {_TASKS} SELECT o_custkey, {_COLLAPSE} FROM t GROUP BY 1")
def stage_collapse(spark, d):
    return workflow.stage_collapse(_tasks(spark, d), ["o_custkey"])


@_query(f"WITH {_TASKS}, s AS (SELECT o_custkey, o_orderpriority, {_COLLAPSE} FROM t GROUP BY 1, 2) SELECT o_orderpriority, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) AS total FROM s GROUP BY 1")
def cohort_rollup(spark, d):
    return workflow.cohort_rollup(workflow.stage_collapse(_tasks(spark, d), ["o_custkey", "o_orderpriority"]), ["o_orderpriority"])


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def run_latest_first(spark, d):
    return workflow.latest_runs(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


_QUADRANT = "CASE WHEN l_partkey <= 1000 - 64 AND l_suppkey <= 50 - 4 THEN 1 WHEN l_partkey >= 1000 + 64 AND l_suppkey <= 50 - 4 THEN 2 WHEN l_partkey <= 1000 - 64 AND l_suppkey >= 50 + 4 THEN 3 WHEN l_partkey >= 1000 + 64 AND l_suppkey >= 50 + 4 THEN 4 ELSE 0 END"


def _folds(spark, d):
    li = _t(spark, d, "lineitem")
    x = spatial.quadrant(F.col("l_partkey"), F.col("l_suppkey") * 16, F.lit(1000), F.lit(800), 64)
    return li.withColumn("fold", x)


@_query(f"SELECT ({_QUADRANT})::INT AS fold, count(*) AS n FROM lineitem GROUP BY 1")
def quadrant_folds(spark, d):
    return _folds(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH c AS (SELECT l_returnflag, ({_QUADRANT})::INT AS fold, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT l_returnflag, fold, n, round(n / sum(n) OVER (PARTITION BY fold), 6) AS share FROM c""")
def fold_composition(spark, d):
    return metrics.crosstab(_folds(spark, d), "l_returnflag", "fold").withColumn("share", F.round("share", 6))


@_query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20")
def cap_per_class(spark, d):
    return cells.cap_per_class(_t(spark, d, "embeddings").select("vec_id", "label"), "label", 20, ["vec_id"])


_LONG = "e AS (SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@_query(f"WITH {_LONG} SELECT label, dim, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM e GROUP BY 1, 2")
def embedding_stats(spark, d):
    e = _t(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return features.embedding_stats(e, "embedding", ["label"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) SELECT event_id, round((value - m) / sd, 6) AS z FROM events JOIN s USING (event_type)")
def zscore(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("marker"), F.col("value").alias("v"))
    pooled = stats.pool(stats.slide_partials(e.withColumn("slide_id", F.lit(0))))
    return features.zscore(e, pooled).select("event_id", F.round("z", 6).alias("z"))


def _predicted(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return learning.nearest_centroid(e, "label", "embedding", "vec_id").select("vec_id", F.col("label").alias("y"), F.col("predicted").alias("y_hat"), "distance")


_PRED = f"""{_LONG}, c AS (SELECT label AS predicted, dim, avg(v) AS c FROM e GROUP BY 1, 2),
  s AS (SELECT vec_id, label, predicted, round(sum((v - c) * (v - c)), 9) AS dist FROM e JOIN c USING (dim) GROUP BY 1, 2, 3),
  p AS (SELECT vec_id, label AS y, predicted AS y_hat, dist FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, predicted) = 1)"""
_PER_CLASS = f"""{_PRED}, l AS (SELECT label, (SELECT count(*) FROM p WHERE y = label) AS nt, (SELECT count(*) FROM p WHERE y_hat = label) AS ns, (SELECT count(*) FROM p WHERE y = label AND y_hat = label) AS tp
  FROM (SELECT DISTINCT y AS label FROM p UNION SELECT DISTINCT y_hat FROM p))"""


@_query(f"WITH {_PRED} SELECT y, y_hat, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM p GROUP BY 1, 2")
def confusion(spark, d):
    return metrics.confusion(_predicted(spark, d)).withColumn("share", F.round("share", 6))


@_query(f"WITH {_PER_CLASS} SELECT round(avg(CASE WHEN nt + ns > 0 THEN 2.0 * tp / (nt + ns) ELSE 0 END), 6) AS macro_f1 FROM l")
def macro_f1(spark, d):
    return metrics.summary(_predicted(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"))


@_query(f"WITH {_PER_CLASS} SELECT round(avg(tp / nt) FILTER (WHERE nt > 0), 6) AS balanced_accuracy FROM l")
def balanced_accuracy(spark, d):
    return metrics.summary(_predicted(spark, d)).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def _scores(spark, d):
    p = _t(spark, d, "lineitem")
    return p.select(F.col("l_linestatus").alias("label"), (F.col("l_quantity") > 25).alias("is_true"), F.floor(F.col("l_extendedprice") / 500).cast("double").alias("score"))


_SCORES = "s AS (SELECT l_linestatus AS label, l_quantity > 25 AS is_true, floor(l_extendedprice / 500) AS score FROM lineitem)"


@_query(f"""WITH {_SCORES}, r AS (SELECT label, is_true, rank() OVER w + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS rk FROM s WINDOW w AS (PARTITION BY label ORDER BY score))
  SELECT label, round((sum(rk) FILTER (WHERE is_true) - count(*) FILTER (WHERE is_true) * (count(*) FILTER (WHERE is_true) + 1) / 2) / (count(*) FILTER (WHERE is_true)::DOUBLE * count(*) FILTER (WHERE NOT is_true)), 6) AS auc FROM r GROUP BY 1""")
def ovr_auc(spark, d):
    return metrics.ovr_auc(_scores(spark, d)).withColumn("auc", F.round("auc", 6))


@_query(f"""WITH {_SCORES}, t AS (SELECT label, score, count(*) AS n, count(*) FILTER (WHERE is_true) AS pos FROM s GROUP BY 1, 2),
  c AS (SELECT label, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(pos) OVER (PARTITION BY label) AS tot FROM t WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT label, round(sum(tp::DOUBLE / al * pos / tot), 6) AS average_precision FROM c WHERE tot > 0 GROUP BY 1""")
def average_precision(spark, d):
    return metrics.average_precision(_scores(spark, d)).withColumn("average_precision", F.round("average_precision", 6))


@_query(f"""WITH {_LONG}, p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM e a JOIN e b ON a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY 1, 2)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour)::INT AS rank, neighbour, round(dist, 6) AS distance FROM p QUALIFY rank <= 5""")
def knn_topk(spark, d):
    return learning.knn(_t(spark, d, "embeddings"), 5, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@_query("SELECT vec_id, label, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label)), 6) AS weight FROM embeddings")
def balanced_weights(spark, d):
    return features.balanced_weights(_t(spark, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", "label", F.round("weight", 6).alias("weight"))


@_query("SELECT event_id, (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))))::BIGINT AS duration_s FROM events")
def task_duration(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").select("event_id", F.lag("ts").over(w).alias("started_at"), F.col("ts").alias("completed_at"))
    return workflow.durations(e).select("event_id", "duration_s")


@_query("SELECT event_id, length(props) AS size, props = '' OR props IS NULL AS blank FROM events")
def blank_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.length("props").cast("bigint").alias("size"), N.is_blank(F.col("props")).alias("blank"))


@_query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, left(sha1(p_name), 12) AS slide_id FROM part")
def name_slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", N.slugify(F.col("p_name")).alias("slug"), N.slide_id(F.col("p_name")).alias("slide_id"))


@_query()
def kmeans_clusters(spark, d):
    return learning.kmeans(_t(spark, d, "embeddings"), 8, "vec_id", "embedding")


@_query()
def communities(spark, d):
    return learning.label_propagation(learning.knn(_t(spark, d, "embeddings"), 15, "vec_id", "embedding"), rounds=5)


@_query()
def linear_probe(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % 4 + 1).cast("int").alias("fold"))
    out = learning.cross_validate(e, "fold", "embedding", "label")
    return out.select("vec_id", "label", "fold", F.col("prediction").cast("int").alias("prediction"))


@_query()
def stand_in_encoder(spark, d):
    return features.encode(_t(spark, d, "embeddings"), "random_projection", "embedding", ["vec_id"])


@_query()
def mask_components(spark, d):
    """Components of a mask whose rows are suppliers and whose runs are spans of part keys."""
    li = _t(spark, d, "lineitem").select((F.col("l_returnflag")).alias("slide_id"), F.col("l_suppkey").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x_start"), (F.col("l_partkey") + 2).cast("int").alias("x_end"))
    return morphology.component_sizes(morphology.components(morphology.merge_runs(li), connectivity=4))


@_query()
def tissue_hull(spark, d):
    pts = _t(spark, d, "supplier").select(F.lit("s").alias("slide_id"), (F.col("s_suppkey") * 37 % 211).cast("double").alias("x"), (F.col("s_suppkey") * 91 % 173).cast("double").alias("y"))
    return morphology.convex_hulls(pts)


@_query("""WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10000000 + l_partkey * 100 + l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)
  SELECT l_suppkey, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber AS k FROM n WHERE i IN (SELECT floor(t * (c - 1) / 11) FROM unnest(range(0, 12)) u(t))""")
def montage_sample(spark, d):
    li = _t(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("k"))
    return report.evenly_spaced(li, ["l_suppkey"], "k", 12)


@_query("""SELECT p_partkey, (SELECT n FROM unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]) t(n) ORDER BY abs(p_retailprice - n), n LIMIT 1)::INT AS bar FROM part""")
def scalebar(spark, d):
    return _t(spark, d, "part").select("p_partkey", report.nice_length(F.col("p_retailprice")).alias("bar"))


@_query("SELECT event_type, user_id % 40 AS y, event_id % 40 AS x, round(avg(value), 6) AS p FROM events GROUP BY 1, 2, 3 HAVING avg(value) >= 50")
def tile_vote(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("slide_id"), (F.col("user_id") % 40).alias("y"), (F.col("event_id") % 40).alias("x"), F.col("value").alias("p"))
    return colour.tile_vote(e, 50.0).select(F.col("slide_id").alias("event_type"), "y", "x", F.round("p", 6).alias("p"))


@_query("""WITH b AS (SELECT l_linenumber, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
  SELECT l_suppkey AS y, l_partkey % 50 AS x, round(sum((l_quantity - lo) / (hi - lo) * 0.1 * l.l_linenumber / (SELECT count(DISTINCT l_linenumber) FROM lineitem)), 6) AS r
  FROM lineitem l JOIN b ON l.l_linenumber = b.l_linenumber GROUP BY 1, 2""")
def pseudo_rgb(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_idx"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 50).alias("x"), F.col("l_quantity").alias("q"))
    b = li.groupBy("channel_idx").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    px = li.join(b, "channel_idx").withColumn("v", raster.stretch(F.col("q"), F.col("lo"), F.col("hi")))
    colours = spark.range(1, 8).select(F.col("id").cast("int").alias("channel_idx"), (F.col("id") * 0.1).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))
    return raster.pseudo_rgb(px.drop("lo", "hi"), colours).select("y", "x", F.round("r", 6).alias("r"))


@_query("SELECT p_type AS name, min(p_partkey) AS first FROM part GROUP BY 1")
def ordered_union(spark, d):
    return report.ordered_union(_t(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("first")), "name", "first")


@_query()
def name_resolver(spark, d):
    n = _t(spark, d, "nation")
    low = F.lower("n_name")
    vocabulary = n.where("n_nationkey % 2 = 0").select(low.alias("marker"))
    aliases = n.where("n_nationkey % 2 = 1 and n_nationkey % 3 = 0").select(low.alias("name"), F.concat(F.lit("alias"), F.col("n_nationkey")).alias("target"))
    return resolvers.resolve_names(n.select(F.col("n_name").alias("name")), vocabulary, aliases)


@_query("""WITH b AS (SELECT p_partkey AS slide_id, p_size FROM part), t AS (SELECT l_partkey AS slide_id, l_suppkey, l_quantity / 50 AS prop FROM lineitem)
  SELECT slide_id, count(*) AS n, count(*) FILTER (WHERE prop > 0.5) AS touching, round(avg(prop), 6) AS mean_share FROM t GROUP BY 1""")
def patch_counts(spark, d):
    p = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("slide_id"), (F.col("l_quantity") / 50).alias("share"))
    out = report.patch_counts(p.withColumn("tissue_prop", F.when(F.col("share") > 0.5, F.col("share")).otherwise(-F.col("share"))), ["slide_id"])
    mean = p.groupBy("slide_id").agg(F.round(F.avg("share"), 6).alias("mean_share"))
    return out.drop("mean_share").join(mean, "slide_id")


@_query("""SELECT vec_id % 5 AS slide_id, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean, count(embedding[i]) AS n
  FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i) GROUP BY 1, 2""")
def slide_mean_features(spark, d):
    """The mean of every component a slide, one row a component."""
    e = _t(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("slide_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return features.embedding_stats(e, "embedding", ["slide_id"]).select("slide_id", "dim", F.round("mean", 6).alias("mean"), "n")


@_query("""WITH p AS (SELECT p_partkey AS slide_id, ['CYX', 'YXS', 'TYXC'][(p_partkey % 3 + 1)::INT] AS axes FROM part),
  q AS (SELECT slide_id, axes, t.page, u.sample, CASE WHEN axes = 'CYX' THEN 1 ELSE 3 END AS ns FROM p, unnest([0, 1, 2, 3]) t(page), unnest([0, 1, 2]) u(sample))
  SELECT slide_id, axes, (CASE axes WHEN 'CYX' THEN page WHEN 'YXS' THEN sample ELSE page * 3 + sample END)::INT AS channel_idx FROM q
  WHERE (axes <> 'CYX' OR sample = 0) AND (axes <> 'YXS' OR page = 0)""")
def harmonize_layouts(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), F.element_at(F.array(*map(F.lit, ("CYX", "YXS", "TYXC"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("axes"))
    p = p.withColumns({"n_pages": F.when(F.col("axes") == "YXS", 1).otherwise(4), "n_samples": F.when(F.col("axes") == "CYX", 1).otherwise(3)})
    planes = p.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1))).withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("n_samples") - 1)))
    return harmonize.harmonize(planes).select("slide_id", "axes", "channel_idx")


_NAMED = "['Pan-CK', 'CD3', 'Vimentin', 'Collagen IV', 'DAPI-1', 'CD20']"


def _named(spark, d):
    names = F.array(*map(F.lit, ("Pan-CK", "CD3", "Vimentin", "Collagen IV", "DAPI-1", "CD20")))
    return _t(spark, d, "part").select(F.col("p_size").alias("slide_id"), F.col("p_partkey").alias("channel_idx"), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("marker"), (F.col("p_retailprice") > 1000).alias("keep"))


@_query(f"SELECT p_size AS slide_id, p_partkey AS channel_idx, {_NAMED}[(p_partkey % 6 + 1)::INT] AS marker FROM part WHERE p_partkey % 6 IN (0, 2, 3)")
def default_structural(spark, d):
    return cohort.default_structural(_named(spark, d)).select("slide_id", "channel_idx", "marker")


@_query("""SELECT p_size AS slide_id, p_partkey AS channel_idx FROM part WHERE p_partkey % 6 IN (0, 1)""")
def structural_by_family(spark, d):
    registry = spark.createDataFrame([("PanCK", "epithelial_keratin"), ("CD3e", "cytoskeleton"), ("CD20", "immune"), ("DAPI", "ecm_matrix"), ("Vimentine", "qc_mask")], "marker_name string, family string")
    named = _named(spark, d).withColumn("marker", F.when(F.col("marker") == "Pan-CK", "PANCK").when(F.col("marker") == "CD3", "CD3e").otherwise(F.col("marker")))
    return cohort.structural_by_family(named, registry).select("slide_id", "channel_idx")


@_query("SELECT p_size AS slide_id, coalesce(min(p_partkey) FILTER (WHERE p_retailprice > 1000), min(p_partkey)) AS nuclear_idx FROM part WHERE p_partkey % 6 = 4 GROUP BY 1")
def nuclear_of_slides(spark, d):
    from ..operators import markers as m

    return m.nuclear_channel(_named(spark, d))


@_query("""WITH c AS (SELECT DISTINCT user_id, event_type FROM events) SELECT DISTINCT user_id AS slide_id FROM c WHERE length(event_type) % 2 = 0""")
def guardrail_drift(spark, d):
    channels = _t(spark, d, "events").select(F.col("user_id").alias("slide_id"), F.col("event_type").alias("raw")).distinct()
    channels = channels.select("slide_id", F.xxhash64("raw").alias("channel_idx"), "raw", F.col("raw").alias("marker"), F.lit("RESOLVED").alias("match"), F.lit(True).alias("keep"))
    mapped = F.when(F.length("raw") % 2 == 0, F.upper("raw")).otherwise(F.col("raw"))
    resolution = channels.select("raw").distinct().select(F.col("raw").alias("original_name"), mapped.alias("marker"), F.lit("RESOLVED").alias("status"), F.lit(True).alias("keep"))
    return cohort.drifted(channels, resolution)


@_query("""WITH t AS (SELECT o_custkey AS slide_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'tissue' WHEN '2-HIGH' THEN 'patch' ELSE 'ingest' END AS stage FROM orders WHERE o_orderstatus = 'F')
  SELECT slide_id, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM t WHERE stage <> 'ingest' AND slide_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def stale_reports(spark, d):
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "tissue").when(F.col("o_orderpriority") == "2-HIGH", "patch").otherwise("ingest")
    tasks = _t(spark, d, "orders").select(F.col("o_custkey").alias("slide_id"), stage.alias("stage"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    changed = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slide_id"))
    return cohort.stale_stages(changed, tasks).withColumn("stages", F.array_join("stages", ","))


@_query(f"""WITH n AS (SELECT p_type AS marker, min(p_partkey) AS ord FROM part GROUP BY 1), k AS (SELECT DISTINCT {_KEY.format('p_type')} AS k FROM part WHERE p_size < 3)
  SELECT marker, row_number() OVER (ORDER BY ord, marker)::INT AS place FROM n WHERE {_KEY.format('marker')} NOT IN (SELECT k FROM k)""")
def novel_without_row(spark, d):
    p = _t(spark, d, "part")
    novel = p.groupBy(F.col("p_type").alias("marker")).agg(F.min("p_partkey").alias("ord"))
    return cohort.missing_novel(novel, p.where("p_size < 3").select(F.col("p_type").alias("marker_name"))).select("marker", "place")


@_query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def fold_rows_complete(spark, d):
    return checks.fold_rows(_t(spark, d, "labels").select("doc_id", "quality"), _t(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@_query("SELECT p_partkey AS slide_id, 's' || p_partkey || '.ome.tiff' AS name, CASE WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 's' || p_partkey || '.csv' END AS file FROM part")
def artifact_by_stem(spark, d):
    slides = _t(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), F.concat(F.lit("s"), F.col("p_partkey"), F.lit(".ome.tiff")).alias("name"))
    return checks.artifact_of(slides, _t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".csv")).alias("file")))


@_query("""WITH p AS (SELECT l_returnflag AS slide_id, l_suppkey AS cell_id, l_linenumber AS y, l_partkey AS x, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
  SELECT slide_id, cell_id, y, x, CASE WHEN x < cell_id * 20 AND y % 2 = 1 THEN v ELSE 0 END AS v FROM p""")
def cell_footprint(spark, d):
    li = _t(spark, d, "lineitem")
    px = li.groupBy(F.col("l_returnflag").alias("slide_id"), F.col("l_suppkey").alias("cell_id"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("x")).agg(F.sum("l_quantity").alias("v"))
    runs = li.where("l_linenumber % 2 = 1").select(F.col("l_returnflag").alias("slide_id"), F.col("l_suppkey").alias("cell_id"), F.col("l_linenumber").alias("y"), F.lit(0).alias("x_start"), (F.col("l_suppkey") * 20).alias("x_end")).distinct()
    return checks.footprint(px, runs)


@_query("SELECT doc_id AS cell_id, doc_id % 90 AS x, n_chars % 70 AS y, quality AS label FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 90 >= 10 AND doc_id % 90 < 50 AND n_chars % 70 >= 5 AND n_chars % 70 < 45")
def inset_labels(spark, d):
    cells_ = _t(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), (F.col("doc_id") % 90).alias("x"), (F.col("n_chars") % 70).alias("y"))
    return checks.in_inset(cells_, _t(spark, d, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").alias("label")), 10, 5, 40)


@_query("SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type)::INT AS place FROM part GROUP BY 1")
def class_abundance(spark, d):
    return checks.abundance(_t(spark, d, "part"), "p_type")


@_query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS processed, count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed FROM orders")
def cohort_outcome(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("error")
    return checks.cohort_result(_t(spark, d, "orders").select(status.alias("status")))


@_query("""WITH p AS (SELECT p_size AS slide_id, CASE WHEN p_size % 3 = 0 THEN 'carta' WHEN p_partkey % 2 = 0 THEN 'otsu' ELSE 'carta' END AS method FROM part),
  m AS (SELECT slide_id, count(DISTINCT method) AS n, min(method) AS sole FROM p GROUP BY 1) SELECT slide_id, CASE WHEN n = 1 THEN sole ELSE 'otsu' END AS method FROM m""")
def tissue_method_choice(spark, d):
    method = F.when(F.col("p_size") % 3 == 0, "carta").when(F.col("p_partkey") % 2 == 0, "otsu").otherwise("carta")
    return checks.tissue_method(_t(spark, d, "part").select(F.col("p_size").alias("slide_id"), method.alias("method"))).select("slide_id", "method")


@_query("SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(p_name ORDER BY p_partkey))[1:0] || list(p_name ORDER BY p_partkey)[1:5], ';') AS shown FROM part GROUP BY 1")
def offending_names(spark, d):
    return checks.offending(_t(spark, d, "part"), ["p_brand"], "p_name", "p_partkey").withColumn("shown", F.array_join("shown", ";"))

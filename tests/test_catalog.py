"""Every imaging query with a DuckDB twin gives the twin's rows; all others give rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tilewright.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plain(v):
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return "null"
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-6)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", ["kmeans_clusters", "stand_in_encoder", "mask_components", "tissue_hull"])
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_box_join_has_no_nested_loop(spark):
    plan = catalog.pixel_box_mean(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_slide_means_take_every_component(spark):
    e = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    got = {(r.slide_id, r.dim): (r.mean, r.n) for r in catalog.slide_mean_features(spark, FOLDER).collect()}
    assert len(got) == 5 * len(e.embedding[0])
    for slide, own in e.groupby(e.vec_id % 5):
        for dim in range(len(own.embedding.iloc[0])):
            x = [float(v[dim]) for v in own.embedding]
            assert math.isclose(got[slide, dim][0], sum(x) / len(x), abs_tol=2e-6) and got[slide, dim][1] == len(x)


def test_name_resolver_brute(spark):
    import difflib

    names = pd.read_parquet(f"{FOLDER}/nation.parquet")
    low = {n: n.lower() for n in names.n_name}
    vocabulary = sorted(n.lower() for n, k in zip(names.n_name, names.n_nationkey) if k % 2 == 0)
    want = set()
    for n, k in zip(names.n_name, names.n_nationkey):
        close = difflib.get_close_matches(low[n], vocabulary, n=1, cutoff=0.8)
        if k % 2 == 0:
            want.add((n, low[n], "exact"))
        elif k % 3 == 0:
            want.add((n, f"alias{k}", "alias"))
        else:
            want.add((n, close[0], "close") if close else (n, low[n], "cleaned"))
    assert {(r["name"], r["target"], r["step"]) for r in catalog.name_resolver(spark, FOLDER).collect()} == want and any(s == "close" for *_, s in want)

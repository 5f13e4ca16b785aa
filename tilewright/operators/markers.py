"""Marker names against a registry: matching, the reviewed map, panels and channel ids."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_blank, is_nuclear, is_qc, matches_any, normalize_key

RESOLVED, REVIEW, NOVEL = "RESOLVED", "REVIEW", "NOVEL"
SMALL = 10_000  # registry rows that may be broadcast


def first_wins(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row a key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_order"))
    return rows.withColumns({"_key": key, "_order": order}).withColumn("_rank", rank).where("_rank = 1").drop("_key", "_order", "_rank")


def _small(registry: DataFrame) -> DataFrame:
    """A broadcast hint only for a registry whose size has been checked."""
    return F.broadcast(registry) if registry.limit(SMALL + 1).count() <= SMALL else registry


def match_markers(names: DataFrame, registry: DataFrame) -> DataFrame:
    """names(original_name) with the registry name of an equal key, RESOLVED or REVIEW."""
    keyed = first_wins(registry.select("marker_name").where(F.col("marker_name").isNotNull()), normalize_key(F.col("marker_name")), F.col("marker_name"))
    keyed = keyed.select(normalize_key(F.col("marker_name")).alias("_key"), "marker_name")
    joined = names.withColumn("_key", normalize_key(F.col("original_name"))).join(_small(keyed), "_key", "left").drop("_key")
    return joined.select(*names.columns, F.coalesce("marker_name", F.lit("")).alias("mapped_canonical_name"), F.when(F.col("marker_name").isNull(), REVIEW).otherwise(RESOLVED).alias("status"))


def build_marker_map(names: DataFrame, registry: DataFrame) -> DataFrame:
    """One row a distinct name; names of control channels map to themselves."""
    out = match_markers(names.select("original_name").where("original_name is not null").distinct(), registry)
    qc = is_qc(F.col("original_name"))
    return out.select("original_name", F.when(qc, F.col("original_name")).otherwise(F.col("mapped_canonical_name")).alias("mapped_canonical_name"), F.when(qc, RESOLVED).otherwise(F.col("status")).alias("status"))


def suggestions(unmatched: DataFrame, registry: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` likeliest registry names of each unmatched one: containment, common prefix, then similarity.

    Similarity is a sequence matcher's ratio, which has no SQL form, so a Pandas function scores
    all of the (size-checked) registry for each batch of names."""
    if registry.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"suggestions are for registries of at most {SMALL} names")
    known = [(r["marker_name"], r["k"]) for r in registry.where("marker_name is not null").select("marker_name", normalize_key(F.col("marker_name")).alias("k")).orderBy("marker_name").collect()]

    @F.pandas_udf("array<string>")
    def best(keys: pd.Series) -> pd.Series:
        def rank(key: str) -> list[str]:
            def score(item: tuple[str, str]) -> tuple:
                k = item[1]
                prefix = next((i for i, (a, b) in enumerate(zip(key, k)) if a != b), min(len(key), len(k)))
                return (key in k or k in key, prefix, difflib.SequenceMatcher(None, key, k).ratio())

            return [name for name, _ in sorted(known, key=score, reverse=True)[:n]]

        return keys.map(lambda k: rank(k) if k else [])

    return unmatched.withColumn("suggestions", best(normalize_key(F.col("original_name"))))


def validate(marker_map: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with a problem: unresolved (blank name) or invalid (named, not novel, not registered)."""
    known = _small(registry.select(F.col("marker_name").alias("_known")).distinct())
    joined = marker_map.join(known, F.col("mapped_canonical_name") == F.col("_known"), "left")
    problem = (
        F.when(is_qc(F.col("original_name")), None).when(is_blank(F.col("mapped_canonical_name")), "unresolved")
        .when((F.col("status") != NOVEL) & F.col("_known").isNull(), "invalid")
    )
    return joined.withColumn("problem", problem).where("problem is not null").drop("_known")


def promote(marker_map: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows under review or novel whose name is registered become resolved."""
    known = _small(registry.select(F.col("marker_name").alias("_known")).distinct())
    joined = marker_map.join(known, F.col("mapped_canonical_name") == F.col("_known"), "left")
    return joined.withColumn("status", F.when(F.col("status").isin(REVIEW, NOVEL) & F.col("_known").isNotNull(), RESOLVED).otherwise(F.col("status"))).drop("_known")


def resolve(marker_map: DataFrame) -> DataFrame:
    """original_name, marker, status, keep: novel names stand, blanks are under review, keep unless 'no'."""
    blank = is_blank(F.col("mapped_canonical_name"))
    status = F.when(F.col("status") == NOVEL, NOVEL).when(blank, REVIEW).otherwise(RESOLVED)
    keep = F.lower(F.coalesce("keep_for_analysis", F.lit("yes"))) != "no" if "keep_for_analysis" in marker_map.columns else F.lit(True)
    return marker_map.select("original_name", F.when(blank, "").otherwise(F.col("mapped_canonical_name")).alias("marker"), status.alias("status"), keep.alias("keep"))


def apply_panel(channels: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Kept channels whose marker fits an include and no exclude glob, in channel order.

    Every glob must fit some kept marker, and the selection must hold a nuclear stain."""
    include, exclude = include or ["*"], exclude or []
    kept = channels.where(F.coalesce("keep", F.lit(True)))
    counts = kept.agg(*(F.count_if(matches_any(F.col("marker"), [p])).alias(f"p{i}") for i, p in enumerate(include + exclude))).first()
    idle = [p for i, p in enumerate(include + exclude) if not counts[f"p{i}"]]
    if idle:
        raise ValueError(f"globs that fit no kept marker: {idle}")
    chosen = kept.where(matches_any(F.col("marker"), include) & ~matches_any(F.col("marker"), exclude))
    if chosen.where(is_nuclear(F.col("marker"))).isEmpty():
        raise ValueError("the selection holds no nuclear stain")
    return chosen


def qc_keep(names: DataFrame, keep_all: bool = False, extra: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Control channels drop out unless asked for by name or by a glob other than '*'."""
    name = F.col("original_name")
    asked = name.isin(extra or []) | (matches_any(name, [p for p in include or [] if p != "*"]) & ~matches_any(name, exclude or []))
    return names.withColumn("keep", F.lit(True) if keep_all else ~is_qc(name) | asked)


def nuclear_channel(channels: DataFrame) -> DataFrame:
    """By slide: the first nuclear channel among kept ones, else among all."""
    ranked = channels.where(is_nuclear(F.col("marker")))
    return ranked.groupBy("slide_id").agg(F.min_by("channel_idx", F.struct(~F.coalesce("keep", F.lit(True)), "channel_idx")).alias("nuclear_idx"))


def odd_ids(markers: DataFrame, low: int = 103, high: int = 255, group: str = "slide_id") -> DataFrame:
    """The k-th marker without an id, in panel order, gets the k-th odd id that is free in its group."""
    w = Window.partitionBy(group).orderBy("channel_idx")
    missing = markers.where("marker_id is null").withColumn("k", F.row_number().over(w))
    used = markers.where("marker_id is not null").groupBy(group).agg(F.collect_set("marker_id").alias("used"))
    free = F.array_except(F.sequence(F.lit(low), F.lit(high), F.lit(2)), F.coalesce("used", F.array().cast("array<int>")))
    given = missing.join(used, group, "left").withColumn("new_id", F.when(F.col("k") <= F.size(free), F.element_at(free, F.col("k"))).otherwise(F.raise_error(F.lit("no odd ids are left")).cast("int")))
    return given.select(group, "channel_idx", "marker", F.col("new_id").alias("marker_id")).unionByName(markers.where("marker_id is not null").select(group, "channel_idx", "marker", F.col("marker_id").cast("int").alias("marker_id")))


def heterogeneous(channels: DataFrame) -> DataFrame:
    """(slide_id, marker) that other slides have and this one lacks."""
    have = channels.select("slide_id", "marker").distinct()
    return have.select("slide_id").distinct().join(have.groupBy().agg(F.collect_set("marker").alias("all")), F.lit(True)).select("slide_id", F.explode("all").alias("marker")).join(have, ["slide_id", "marker"], "left_anti")

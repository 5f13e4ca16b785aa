"""Marker names of a cohort: the reviewed map, its guardrail, and the channels it names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_marker_name, is_blank, is_nuclear, is_qc, matches_any, normalize_key
from . import markers
from .markers import NOVEL, RESOLVED, REVIEW, SMALL

# Cleaned names of the scaffold stains tissue is found by, and registry families.
STRUCTURAL_NAMES = ("pancytokeratin", "panck", "pan_ck", "cytokeratin", "vimentin", "collagen_iv", "collageniv", "col4", "col_iv", "collagen4")
STRUCTURAL_FAMILIES = ("epithelial_marker", "epithelial_keratin", "epithelial_junction", "ecm_matrix", "cytoskeleton")
QC_FAMILY = "qc_mask"
CLOSE = 0.8


class MarkerMapError(ValueError):
    """A map that cannot be applied; ``rows`` are its problems and ``repaired`` the map with these under review."""

    def __init__(self, message: str, rows: list, repaired: DataFrame):
        super().__init__(message)
        self.rows, self.repaired = rows, repaired


def effective_name(original: Column, mapped: Column) -> Column:
    """What a panel's globs see of a row: the name it is mapped to, else its own, cleaned."""
    return F.when(is_blank(mapped), clean_marker_name(original)).otherwise(mapped)


def panel_keep(marker_map: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Add keep_for_analysis: yes where the effective name fits an include and no exclude glob."""
    name = effective_name(F.col("original_name"), F.col("mapped_canonical_name"))
    globs = [*(include or []), *(exclude or [])]
    if globs:
        counts = marker_map.agg(*(F.count_if(matches_any(name, [p])).alias(f"p{i}") for i, p in enumerate(globs))).first()
        idle = [p for i, p in enumerate(globs) if not counts[f"p{i}"]]
        if idle:
            raise ValueError(f"globs that fit no marker: {idle}")
    fits = matches_any(name, include or ["*"]) & ~matches_any(name, exclude or [])
    return marker_map.withColumn("keep_for_analysis", F.when(fits, "yes").otherwise("no"))


def reset_flagged(marker_map: DataFrame, registry: DataFrame) -> DataFrame:
    """The map with every row that names no registered marker, though it must, back under review."""
    bad = markers.validate(marker_map, registry).where("problem = 'invalid'").select("original_name").distinct()
    flagged = marker_map.join(F.broadcast(bad.withColumn("_bad", F.lit(True))) if bad.limit(SMALL + 1).count() <= SMALL else bad.withColumn("_bad", F.lit(True)), "original_name", "left")
    return flagged.withColumn("status", F.when(F.col("_bad"), REVIEW).otherwise(F.col("status"))).select(*marker_map.columns)


def validate_and_flag(marker_map: DataFrame, registry: DataFrame) -> DataFrame:
    """The map itself where every row can be applied, else an error that carries what to mend."""
    problems = markers.validate(marker_map, registry).select("original_name", "problem").orderBy("original_name").limit(1000).collect()
    if problems:
        shown = ", ".join(f"{r['original_name']} ({r['problem']})" for r in problems[:5])
        raise MarkerMapError(f"{len(problems)} rows of the map cannot be applied: {shown}", problems, reset_flagged(marker_map, registry))
    return marker_map


def resolve_cohort_markers(
    channels: DataFrame, registry: DataFrame, existing: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
    keep_all: bool = False, extra: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(map to keep, resolution of all names) from channels(slide_id, raw), or from a map that was reviewed before.

    A reviewed map is applied as it stands. A new one has a row a name; a panel says what is kept, and control
    channels drop out of it unless asked for. Only kept rows are for review; the resolution covers every name."""
    if existing is not None:
        rows = validate_and_flag(existing, registry)
    else:
        names = channels.where(~is_blank(F.col("raw"))).select(F.col("raw").alias("original_name"))
        if names.isEmpty():
            raise ValueError("no source carries marker names; give one name a channel")
        rows = markers.build_marker_map(names, registry)
    if include or exclude:
        rows = panel_keep(rows, include, exclude)
    elif "keep_for_analysis" not in rows.columns:
        rows = rows.withColumn("keep_for_analysis", F.lit("yes"))
    if existing is None or include or exclude:
        asked = markers.qc_keep(rows, keep_all, extra, include, exclude)
        named = F.col("original_name").isin(extra or [])
        rows = asked.withColumn("keep_for_analysis", F.when(~F.col("keep"), "no").when(named, "yes").otherwise(F.col("keep_for_analysis"))).drop("keep")
    return rows.where("keep_for_analysis <> 'no'"), markers.resolve(rows)


def apply_names(channels: DataFrame, resolution: DataFrame, set_keep: bool = False) -> DataFrame:
    """Channels with the resolved marker and match of their raw name, and with ``set_keep`` its keep as well.

    A name the resolution lacks is left out of the analysis when keep is set, and untouched otherwise."""
    found = resolution.select(F.col("original_name").alias("raw"), F.col("marker").alias("_m"), F.col("status").alias("_s"), F.col("keep").alias("_k"))
    joined = channels.join(found, "raw", "left")
    known = F.col("_s").isNotNull()
    out = joined.withColumns({"marker": F.when(known & (F.col("_m") != ""), F.col("_m")).otherwise(F.col("marker")), "match": F.when(known, F.col("_s")).otherwise(F.col("match"))})
    if set_keep:
        out = out.withColumn("keep", F.when(known, F.col("_k")).otherwise(F.lit(False)))
    return out.select(*channels.columns)


def uncovered_channels(channels: DataFrame, resolution: DataFrame) -> DataFrame:
    """Kept channels whose raw name has no row in the map."""
    kept = channels.where(F.coalesce("keep", F.lit(True)))
    return kept.join(resolution.select(F.col("original_name").alias("raw")).distinct(), "raw", "left_anti")


def without_nuclear(channels: DataFrame) -> DataFrame:
    """Slides whose kept channels hold no nuclear stain."""
    stained = channels.where(F.coalesce("keep", F.lit(True)) & is_nuclear(F.col("marker"))).select("slide_id").distinct()
    return channels.select("slide_id").distinct().join(stained, "slide_id", "left_anti")


def enforce(marker_map: DataFrame, registry: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(promoted map, channels in line with it, slides that changed): every check first, then the names.

    Only slides that differ need to be written again; keep is frozen."""
    promoted = markers.promote(validate_and_flag(marker_map, registry), registry)
    resolution = markers.resolve(promoted)
    missing = uncovered_channels(channels, resolution).select("slide_id", "raw").orderBy("slide_id", "raw").limit(6).collect()
    if missing:
        raise ValueError(f"kept channels without a row in the map: {[(r['slide_id'], r['raw']) for r in missing]}")
    synced = apply_names(channels, resolution)
    bare = [r["slide_id"] for r in without_nuclear(synced).orderBy("slide_id").limit(6).collect()]
    if bare:
        raise ValueError(f"slides without a kept nuclear stain: {bare}")
    return promoted, synced, drifted(channels, resolution)


def drifted(channels: DataFrame, resolution: DataFrame) -> DataFrame:
    """Slides whose recorded names differ from the map's."""
    a, b = channels.select("slide_id", "channel_idx", "marker", "match"), apply_names(channels, resolution)
    now = b.select("slide_id", "channel_idx", F.col("marker").alias("_m"), F.col("match").alias("_s"))
    both = a.join(now, ["slide_id", "channel_idx"])
    return both.where(~(F.col("marker").eqNullSafe(F.col("_m")) & F.col("match").eqNullSafe(F.col("_s")))).select("slide_id").distinct()


def inspect(marker_map: DataFrame, registry: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: how many names of each status and problem, and how many slides are in line; nothing is changed."""
    counts = markers.resolve(marker_map).agg(F.count(F.lit(1)).alias("n_markers"), *(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in (RESOLVED, NOVEL, REVIEW)))
    problems = markers.validate(marker_map, registry).agg(F.count(F.lit(1)).alias("n_problems"))
    apart = drifted(channels, markers.resolve(marker_map)).agg(F.count(F.lit(1)).alias("n_drifted"))
    slides = channels.agg(F.countDistinct("slide_id").alias("n_slides"))
    joined = counts.crossJoin(problems).crossJoin(apart).crossJoin(slides)  # one row each
    return joined.withColumn("in_sync", F.col("n_slides") - F.col("n_drifted"))


def stale_stages(drifted_slides: DataFrame, tasks: DataFrame, downstream: tuple[str, ...] = ("tissue", "cells", "patch", "extract")) -> DataFrame:
    """(slide_id, stages) completed stages whose outputs a change of names may have made stale."""
    done = tasks.where(F.col("status") == "completed").where(F.col("stage").isin(*downstream))
    return done.join(drifted_slides, "slide_id", "left_semi").groupBy("slide_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def directory_hint(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Of file stems(directory, stem): directories in which at least two, and half, are marker names, so that they look like the
    channels of one slide."""
    matched = markers.match_markers(names.withColumnRenamed("stem", "original_name"), registry)
    counts = matched.groupBy("directory").agg(F.count_if(F.col("status") == RESOLVED).alias("hits"), F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("hits") >= 2) & (2 * F.col("hits") >= F.col("n")))


def explicit_nuclear(channels: DataFrame, name: str) -> DataFrame:
    """By slide: the first channel whose cleaned marker is exactly the cleaned ``name``; a slide without one is an error."""
    hit = F.min(F.when(clean_marker_name(F.col("marker")) == clean_marker_name(F.lit(name)), F.col("channel_idx")))
    return channels.groupBy("slide_id").agg(hit.alias("_i")).select("slide_id", F.coalesce("_i", F.raise_error(F.concat(F.lit(f"no channel {name} on slide "), F.col("slide_id").cast("string"))).cast("int")).alias("nuclear_idx"))


def resolve_nuclear(channels: DataFrame, name: str | None = None) -> DataFrame:
    """By slide: the named channel, else the first nuclear one kept, else the first of all; none is an error."""
    if name is not None:
        return explicit_nuclear(channels, name)
    found = channels.select("slide_id").distinct().join(markers.nuclear_channel(channels), "slide_id", "left")
    missing = F.raise_error(F.concat(F.lit("no nuclear stain on slide "), F.col("slide_id").cast("string"))).cast("int")
    return found.select("slide_id", F.coalesce("nuclear_idx", missing).alias("nuclear_idx"))


def default_structural(channels: DataFrame) -> DataFrame:
    """Channels of the scaffold stains that tissue is looked for by default."""
    return channels.where(clean_marker_name(F.col("marker")).isin(*STRUCTURAL_NAMES))


def with_family(channels: DataFrame, registry: DataFrame) -> DataFrame:
    """Add family: of the registered marker with the same cleaned name, else of the closest from CLOSE on, else null.

    Names that are equal join; only what is left, one row a name, is compared with the size-checked registry."""
    known = registry.select(clean_marker_name(F.col("marker_name")).alias("_name"), "family").where("_name is not null")
    known = markers.first_wins(known, F.col("_name"), F.col("family"))
    own = channels.withColumn("_name", clean_marker_name(F.col("marker")))
    exact = own.select("_name").distinct().join(markers._small(known), "_name", "left")
    listed = known.orderBy("_name").limit(SMALL + 1).collect()
    if len(listed) > SMALL:
        raise ValueError(f"families are looked up in registries of at most {SMALL} names")
    names, family = [r["_name"] for r in listed], {r["_name"]: r["family"] for r in listed}

    @F.pandas_udf("string")
    def closest(left: pd.Series) -> pd.Series:
        def best(name: str | None) -> str | None:
            found = difflib.get_close_matches(name, names, n=1, cutoff=CLOSE) if name and len(name) >= 3 else []
            return family[found[0]] if found else None

        return left.map(best)

    found = exact.where("family is not null").unionByName(exact.where("family is null").select("_name", closest("_name").alias("family")))
    return own.join(found, "_name", "left").drop("_name")


def structural_by_family(channels: DataFrame, registry: DataFrame) -> DataFrame:
    """Channels of scaffold families; nuclear stains never count, whatever name they resemble."""
    named = with_family(channels.where(~is_nuclear(F.col("marker"))), registry)
    return named.where(F.col("family").isin(*STRUCTURAL_FAMILIES)).drop("family")


def non_qc_channels(channels: DataFrame, registry: DataFrame) -> DataFrame:
    """All channels but those of the control family."""
    return with_family(channels, registry).where(~F.coalesce(F.col("family") == QC_FAMILY, F.lit(False))).drop("family")


def missing_novel(novel: DataFrame, table: DataFrame) -> DataFrame:
    """Novel markers(marker, ord) that the table of additional markers lacks, by key, each once in order of first sight."""
    keyed = markers.first_wins(novel.where(~is_blank(F.col("marker"))), normalize_key(F.col("marker")), F.col("ord"))
    have = table.select(normalize_key(F.col("marker_name")).alias("_k")).distinct()
    return keyed.withColumn("_k", normalize_key(F.col("marker"))).join(have, "_k", "left_anti").drop("_k").withColumn("place", F.row_number().over(Window.orderBy("ord", "marker")))

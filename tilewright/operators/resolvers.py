"""Marker names to a model's vocabulary by steps of falling trust."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_marker_name
from .markers import SMALL, _small

# Names of stains and blanks that gene vocabularies do not hold.
NOT_GENES = ("hoechst", "empty", "blank", "draq")


def resolve_names(names: DataFrame, vocabulary: DataFrame, aliases: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """names(name) with target and step: exact, alias, a part between underscores, the name without an
    isotope ending, the closest at ``cutoff`` or above, else the cleaned name."""
    vocab = _small(vocabulary.select(F.col("marker").alias("_v")).distinct())
    alias = _small(aliases.select(F.col("name").alias("_a"), F.col("target").alias("_t")).dropDuplicates(["_a"]))
    base = names.select("name").distinct().withColumn("clean", clean_marker_name(F.col("name")))
    stripped = F.regexp_replace("clean", r"_\d+[a-z]*$", "")
    whole = F.array(F.struct(F.lit(0).alias("o"), F.lit("exact").alias("how"), F.col("clean").alias("k")))
    parts = F.transform(F.split("clean", "_"), lambda p, i: F.struct((i + 1).alias("o"), F.lit("part").alias("how"), p.alias("k")))
    last = F.array(F.struct(F.lit(10_000).alias("o"), F.lit("stripped").alias("how"), stripped.alias("k")))
    tries = base.select("name", "clean", F.explode(F.concat(whole, parts, last)).alias("t")).select("name", "clean", "t.*").where("k <> ''")
    hit = tries.join(vocab, F.col("k") == F.col("_v"), "left").join(alias, F.col("k") == F.col("_a"), "left")
    target = F.coalesce("_v", "_t")
    how = F.when(F.col("_v").isNull() & (F.col("how") == "exact"), "alias").otherwise(F.col("how"))
    found = hit.where(target.isNotNull()).groupBy("name").agg(F.min_by(F.struct(target.alias("target"), how.alias("step")), F.col("o")).alias("b")).select("name", "b.*")
    rest = base.join(found.select("name"), "name", "left_anti")
    if vocabulary.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"close matches are for vocabularies of at most {SMALL} names")
    known = sorted(r[0] for r in vocabulary.select("marker").where("marker is not null").distinct().collect())

    @F.pandas_udf("string")
    def closest(s: pd.Series) -> pd.Series:
        return s.map(lambda c: next(iter(difflib.get_close_matches(c, known, 1, cutoff)), None) if c else None)

    close = rest.withColumn("_c", closest("clean"))
    return found.unionByName(close.select("name", F.coalesce("_c", "clean").alias("target"), F.when(F.col("_c").isNull(), "cleaned").otherwise("close").alias("step")))


def resolve_genes(names: DataFrame, genes: DataFrame) -> DataFrame:
    """names(channel_idx, name) with the gene of the name, or of the name without separators; stains
    are skipped, the others are reported as dropped."""
    norm = F.regexp_replace(F.lower("name"), "[- ]", "_")
    compact = F.regexp_replace(F.lower("name"), "[-_ ]", "")
    g = genes.select(F.regexp_replace(F.lower("name"), "[- ]", "_").alias("_n"), F.col("target").alias("_g1")).dropDuplicates(["_n"])
    c = genes.select(F.regexp_replace(F.lower("name"), "[-_ ]", "").alias("_c"), F.col("target").alias("_g2")).dropDuplicates(["_c"])
    out = names.join(_small(g), norm == F.col("_n"), "left").join(_small(c), compact == F.col("_c"), "left")
    gene = F.coalesce("_g1", "_g2")
    state = F.when(F.lower("name").rlike("|".join(NOT_GENES)), "skipped").when(gene.isNull(), "dropped").otherwise("kept")
    return out.select("channel_idx", "name", F.when(state == "kept", gene).alias("gene"), state.alias("state"))

"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BYTES_PER_CLASS = 16_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, most_bytes: int = BYTES_PER_CLASS):
    """At most ``limit`` documents a class of (doc_id, text, label), lowest id hash first.

    The label counts cover all rows; the sample they size is bounded by ``limit`` a class,
    so broadcasting its ids is safe too. Null ids, labels and texts take no part; repeated
    label rows count as their largest. See ``_least`` for what reaches the driver.
    """
    clean = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    rate = _rate(clean, limit)
    if rate is None:
        return []
    ids = clean.where(_unit("doc_id") < rate)
    return _least(docs.where("text is not null").join(F.broadcast(ids), "doc_id"), limit, most_bytes)


def by_class(docs: DataFrame, column: str, limit: int, most_bytes: int = BYTES_PER_CLASS):
    """The same from a label column of the documents themselves: (doc_id, text, label)."""
    own = docs.where(F.col(column).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col(column).alias("label"))
    rate = _rate(own, limit)
    return [] if rate is None else _least(own.where(_unit("doc_id") < rate), limit, most_bytes)


def _unit(column: str):
    """The hash of an id, in [0, 1)."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _rate(rows: DataFrame, limit: int):
    """By label: the share of its documents that gives ``limit`` and some more; the counts are over all rows."""
    counts = rows.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()
    if not counts:
        return None
    rate = F.lit(0.0)
    for r in sorted(counts, key=lambda r: str(r["label"])):
        rate = F.when(F.col("label") == r["label"], F.lit((1.2 * limit + 10) / max(1, r["n"]))).otherwise(rate)
    return rate


def _least(rows: DataFrame, limit: int, most_bytes: int) -> list[tuple]:
    """The ``limit`` documents of the lowest id hashes a class, as far as their texts fit ``most_bytes``.

    Of an id that comes more than once its smallest text counts: the rows are told apart by length and hash
    before any text moves, and the cut is made before texts reach the driver."""
    rows = rows.select("doc_id", "text", F.col("label"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("name"))
    one = rows.groupBy("label", "doc_id").agg(F.min(F.struct("size", "name")).alias("least"))
    order = Window.partitionBy("label").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = one.select("label", "doc_id", "least", _unit("doc_id").alias("h")).withColumns({"place": F.count(F.lit(1)).over(order), "filled": F.sum("least.size").over(order)})
    chosen = ranked.where((F.col("place") <= limit) & (F.col("filled") <= most_bytes)).select("label", "doc_id", "h", F.col("least.size").alias("size"), F.col("least.name").alias("name"))
    met = rows.join(F.broadcast(chosen), ["label", "doc_id", "size", "name"]).groupBy("label", "doc_id", "h").agg(F.min("text").alias("text"))
    found = sorted(met.collect(), key=lambda r: (r["h"], r["doc_id"], str(r["label"])))
    return [(r["doc_id"], r["text"], r["label"]) for r in found]

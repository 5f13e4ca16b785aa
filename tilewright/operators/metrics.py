"""Classification metrics as aggregates over (y, y_hat) counts and ranked scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """(y, y_hat, n, share of its row)."""
    counts = rows.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def per_class(rows: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Precision, recall and F1 of each class that occurs on either side; 0 where undefined."""
    counts = rows.groupBy(F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count(F.lit(1)).alias("n"))
    true = counts.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(0)).alias("tp"))
    said = counts.groupBy(F.col("y_hat").alias("label")).agg(F.sum("n").alias("n_said"))
    both = true.join(said, "label", "full").na.fill(0, ["n_true", "tp", "n_said"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("n_said")), ratio(F.col("tp"), F.col("n_true"))
    return both.select("label", "n_true", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_said")).alias("f1"))


def summary(rows: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """One row: macro F1 over all classes, balanced accuracy over those that are true somewhere, accuracy."""
    c = per_class(rows, y, y_hat)
    return c.agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("n_true") > 0, F.col("recall"))).alias("balanced_accuracy"), (F.sum(F.col("recall") * F.col("n_true")) / F.sum("n_true")).alias("accuracy"))


def ovr_auc(scores: DataFrame) -> DataFrame:
    """One-vs-rest area under the ROC curve from (label, is_true, score), ties at average rank.

    Equal scores are counted first, so the windows see distinct scores only."""
    ties = scores.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_true").alias("pos"))
    before = Window.partitionBy("label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("label").agg(F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    auc = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return sums.select("label", F.when((F.col("n1") > 0) & (F.col("n0") > 0), auc).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One-vs-rest average precision from (label, is_true, score); equal scores enter together."""
    ties = scores.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_true").alias("pos"))
    upto = Window.partitionBy("label").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    curve = ties.withColumns({"tp": F.sum("pos").over(upto), "all": F.sum("n").over(upto), "total": F.sum("pos").over(Window.partitionBy("label"))})
    return curve.where("total > 0").groupBy("label").agg(F.sum(F.col("tp") / F.col("all") * F.col("pos") / F.col("total")).alias("average_precision"))


def crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Long crosstab: (row, column, n, share of its column)."""
    counts = rows.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def over_folds(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation over folds, to four places."""
    return results.agg(*(F.round(F.avg(m), 4).alias(f"{m}_mean") for m in metrics), *(F.round(F.stddev_pop(m), 4).alias(f"{m}_std") for m in metrics))

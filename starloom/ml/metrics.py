"""Metrics in Spark: exact rank AUC without a global sort in one task, log loss, regression errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str, label: str) -> float | None:
    """The chance that a positive row scores over a negative one, ties counting half; null without both kinds.

    Counts by score are sorted by range; each range adds the negatives of the ranges before it, from a table of one row a range.
    """
    y = F.when(F.col(label).cast("double") > 0, 1).otherwise(0)
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    ranged = counts.repartitionByRange("s").withColumn("r", F.spark_partition_id())
    own = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("below", F.coalesce(F.sum("n").over(own), F.lit(0)))
    ranges = inside.groupBy("r").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.min("s").alias("first")).collect()
    before, won, p = 0, 0.0, 0
    for r in sorted(ranges, key=lambda r: r["first"]):
        won += r.won + r.p * before
        before += r.n
        p += r.p
    return won / (p * before) if p and before else None


def binary_metrics(df: DataFrame, probability: str, label: str) -> dict:
    """logloss, mean prediction, positive ratio, rows and AUC."""
    y, p = F.col(label).cast("double"), F.greatest(F.least(F.col(probability), F.lit(1 - 1e-15)), F.lit(1e-15))
    r = df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logloss"), F.avg(probability).alias("mean_prediction"), F.avg(y).alias("positive_ratio"), F.count(F.lit(1)).alias("rows")).first()
    return {**r.asDict(), "auc": auc(df, probability, label)}


def regression_metrics(df: DataFrame, prediction: str, label: str) -> dict:
    e = F.col(prediction) - F.col(label)
    r = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(prediction).alias("mean_prediction"), F.count(F.lit(1)).alias("rows")).first()
    return {**r.asDict(), "rmse": r.mse**0.5 if r.mse is not None else None}

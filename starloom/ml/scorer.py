"""Slot-wise scoring: how much each candidate feature adds, alone, to fixed base predictions.

A candidate's model is the base logit plus one weight for each of its bins (quantile bins of numbers, hashed values of
categories). The bins of one feature are disjoint, so each weight is found by its own Newton steps from grouped sums; all
candidates are fitted and scored together in one long table (feature, bin). No Python runs on rows. The rows are summed once, by
feature, bin and base logit on a grid of 10^-``digits``; the sums are written, and the steps run over them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cache, shared_folder
from .linear import quantile_cuts, with_bins


def _long(df: DataFrame, numeric: list[str], categorical: list[str], cuts: dict, buckets: int, base: str, label: str, slots: int) -> DataFrame:
    df = with_bins(df, {f"__bin_{i}": (c, cuts[f"{c}@{buckets}"]) for i, c in enumerate(numeric)})
    pairs: list[Column] = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"__bin_{i}").cast("long"), F.lit(-1).cast("long")).alias("bin")) for i, c in enumerate(numeric)]
    pairs += [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(slots))).alias("bin")) for c in categorical]
    return df.select(F.explode(F.array(*pairs)).alias("e"), F.col(base).cast("double").alias("base"), F.col(label).cast("double").alias("y")).select("e.feature", "e.bin", "base", "y").where("y IS NOT NULL")


def slotwise_scores(train: DataFrame, valid: DataFrame, numeric: list[str], categorical: list[str], base: str, label: str, task: str = "binary", buckets: int = 100, slots: int = 1 << 14, penalty: float = 1.0, steps: int = 4, grid: int = 10_000, digits: int = 4) -> DataFrame:
    """(feature, score): AUC on valid (scores on a grid of 1 / grid of a probability), or the negative mean squared error.

    Weights are at most features * slots rows; they are joined as a table, so no size limit hangs on them.
    """
    cuts = quantile_cuts(train, numeric, (buckets,))
    rows = _long(train, numeric, categorical, cuts, buckets, base, label, slots)
    if task == "binary":
        sums = rows.groupBy("feature", "bin", F.round("base", digits).alias("base")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
        sums = cache(sums, f"{shared_folder(train.sparkSession)}/slots-{uuid.uuid4().hex[:12]}").withColumn("w", F.lit(0.0))
        for _ in range(steps):
            p = 1 / (1 + F.exp(-(F.col("base") + F.col("w"))))
            own = Window.partitionBy("feature", "bin")
            step = (F.sum(F.col("y") - F.col("n") * p).over(own) - penalty * F.col("w")) / (F.sum(F.col("n") * p * (1 - p)).over(own) + penalty)
            sums = sums.withColumn("w", F.col("w") + F.greatest(F.least(step, F.lit(4.0)), F.lit(-4.0)))
        weights = sums.groupBy("feature", "bin").agg(F.first("w").alias("w"))
    else:
        weights = rows.groupBy("feature", "bin").agg((F.sum(F.col("y") - F.col("base")) / (F.count(F.lit(1)) + penalty)).alias("w"))
    held = _long(valid, numeric, categorical, cuts, buckets, base, label, slots).join(weights, ["feature", "bin"], "left").withColumn("z", F.col("base") + F.coalesce("w", F.lit(0.0)))
    if task != "binary":
        return held.groupBy("feature").agg((-F.avg((F.col("z") - F.col("y")) ** 2)).alias("score"))
    s = F.round(grid / (1 + F.exp(-F.col("z")))).cast("long")
    y = F.when(F.col("y") > 0, 1).otherwise(0)
    counts = held.groupBy("feature", s.alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    before = Window.partitionBy("feature").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # at most grid + 1 rows a feature
    won = counts.withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("feature").agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select("feature", F.try_divide(F.col("won"), F.col("p") * F.col("n")).alias("score"))

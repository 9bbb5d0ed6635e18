"""Preparation: temporal and random splits, sampling, distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import micros


def hash_uniform(c: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 (exclusive) of each value's text, the same in every run and engine: the first 52 bits of the MD5 digest of "seed:text"."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _row_key(df: DataFrame, key: str | None) -> Column:
    return F.col(key) if key else F.to_json(F.struct(*df.columns))


def time_cut(df: DataFrame, time: str, share: float, accuracy: int = 10_000) -> int | None:
    """The time in microseconds below which about share of the rows lie."""
    return df.agg(F.percentile_approx(micros(F.col(time)), share, accuracy)).first()[0]


def temporal_split(df: DataFrame, time: str, train_share: float = 0.8, key: str | None = None, accuracy: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(train, test): earlier and later rows. Rows at the cut are dealt by a hash of key so that the shares hold; rows without time are in neither."""
    cut = time_cut(df, time, train_share, accuracy)
    us = micros(F.col(time))
    if cut is None:
        return df.limit(0), df.limit(0)
    n = df.agg(F.count(us), F.sum((us < cut).cast("long")), F.sum((us == cut).cast("long"))).first()
    ratio = min(max((train_share * n[0] - n[1]) / n[2], 0.0), 1.0) if n[2] else 1.0
    tie = hash_uniform(_row_key(df, key)) < ratio
    return df.where((us < cut) | ((us == cut) & tie)), df.where((us > cut) | ((us == cut) & ~tie))


def _share_up_to(df: DataFrame, time: str, share: float, accuracy: int) -> tuple[int, float] | None:
    """(cut, ratio): the time quantile, and the part of the rows up to it that is meant: all, or share where the cut is the latest time."""
    us = micros(F.col(time))
    r = df.agg(F.percentile_approx(us, share, accuracy), F.max(us)).first()
    return None if r[0] is None else (r[0], share if r[0] == r[1] else 1.0)


def validation_split(df: DataFrame, time: str, test_ratio: float = 0.2, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, valid) at the time quantile; rows at the cut are trained on.

    Where the cut is the latest time a share of 1 - test_ratio of all rows, by a hash of key (of the whole row without one), is
    trained on. Rows without time are in valid.
    """
    found = _share_up_to(df, time, 1 - test_ratio, 100_000)
    if found is None:
        return df.limit(0), df
    return old_new_split(df, time, *found, key)


def old_new_split(df: DataFrame, time: str, cut_us: int, ratio: float, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(old, new): a hash-random ratio of the rows up to the cut, and all others. row_id: hashed; the whole row without one."""
    old = F.coalesce((micros(F.col(time)) <= cut_us) & (hash_uniform(_row_key(df, row_id)) < ratio) if ratio < 1 else micros(F.col(time)) <= cut_us, F.lit(False))
    return df.where(old), df.where(~old)


def random_split(df: DataFrame, share: float, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(left, right) by a hash of key: stable whatever the partitions."""
    left = hash_uniform(F.col(key), seed) < share
    return df.where(left), df.where(~left)


def recent_rows(df: DataFrame, time: str, most: int, key: str | None = None) -> DataFrame:
    """df if it has at most that many rows, else about as many: those after a time quantile, or, where this is the latest time, a
    share of all rows by a hash of key (of the whole row without one). Rows without time stay."""
    n = df.count()
    if n <= most:
        return df
    found = _share_up_to(df, time, (n - most - 0.5) / n, 100_000)  # the rank of the last row to go, whatever the rounding
    if found is None:
        return df
    cut, ratio = found
    return old_new_split(df, time, cut, ratio if ratio == 1.0 else 1 - most / n, key)[1]


def shuffled(df: DataFrame, partitions: int, key: str, seed: int = 0) -> DataFrame:
    """df's rows in random order over partitions of about equal size, the same in every run: dealt and sorted by a hash of key."""
    order = hash_uniform(F.col(key), seed)
    return df.repartitionByRange(partitions, order, key).sortWithinPartitions(order, key)


def assign_index(df: DataFrame, name: str = "row_index", order: list[str] | None = None) -> DataFrame:
    """df with a number of its own for each row, 0 to n - 1 by the columns of order (all columns without it); equal rows get different ones.

    Rows are sorted by range; each range starts after the rows of the ranges before it, known from one count for each range.
    """
    order = order or df.columns
    part, own = "__part", "__own"
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    placed = ranged.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long"))
    sizes = placed.groupBy(part).agg(F.max(own).alias("n"))
    before = sizes.select(F.col(part), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), part).withColumn(name, F.col("before") + F.col(own) - 1).select(*df.columns, name)


def top_categories(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(feature, value, n, rank): the n most frequent values of each column, equal counts by value."""
    texts = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(texts.alias("e")).select("e.feature", "e.value").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(feature, n): distinct values of each column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*(count(F.col(c)).alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in columns))).alias("e")).select("e.*")


def max_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n): the most values a row has in each multi-valued column."""
    wide = df.agg(*(F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("long").alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in columns))).alias("e")).select("e.*")


def quantiles(df: DataFrame, column: str, n: int, accuracy: int = 10_000) -> list[float]:
    """n - 1 inner cut points of n ranges with about equal numbers of rows."""
    return df.select(F.percentile_approx(column, [i / n for i in range(1, n)], accuracy)).first()[0] or []


def hot_keys(df: DataFrame, key: str | tuple[str, ...], share: float) -> DataFrame:
    """(key, n): the values (or, for several columns, their combinations) with more than share of the rows."""
    total = df.count()
    return df.groupBy(*((key,) if isinstance(key, str) else key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share * total)


def time_gaps(df: DataFrame, time: str) -> DataFrame:
    """(least_gap, first, last) in microseconds: the smallest gap between distinct times, by ranges of times.

    Distinct times are sorted by range; each range's edge meets its neighbour's in a table of one row for each range.
    """
    us = df.select(micros(F.col(time)).alias("us")).where("us IS NOT NULL").distinct()
    part = us.repartitionByRange("us").withColumn("p", F.spark_partition_id())
    own = Window.partitionBy("p").orderBy("us")
    ranges = part.withColumn("gap", F.col("us") - F.lag("us").over(own)).groupBy("p").agg(F.min("gap").alias("gap"), F.min("us").alias("first"), F.max("us").alias("last"))
    edges = ranges.withColumn("edge", F.col("first") - F.lag("last").over(Window.orderBy("first")))
    return edges.agg(F.min(F.least("gap", "edge")).alias("least_gap"), F.min("first").alias("first"), F.max("last").alias("last"))

"""Window aggregates, over Spark frames where these can express the frame and over bounded lists where they cannot.

Two modes: "golden" follows the feature SQL's expected data, "runtime" the native scorer (no placeholder row, no empty sums).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

NUMERIC = {"sum", "avg", "min", "max", "std"}
WINDOW = ("sum", "avg", "min", "max", "count", "unique_count", "top1_ratio", "ratio")
MULTI = ("sum", "avg", "min", "max", "std", "count", "unique_count", "top3frequency")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(a: Column) -> Column:
    """array<struct<n, v>> of a list's values by value: the runs of the sorted list, so time hardly grows with the number of values."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: F.when(i == 0, True).otherwise(F.get(s, i) != F.get(s, i - 1)))
        ends = lambda b: F.concat(F.slice(b, 2, F.size(s)), F.array(F.size(s)))
        return let(starts, lambda b: F.zip_with(b, ends(b), lambda i, j: F.struct((j - i).alias("n"), F.get(s, i).alias("v"))))

    return let(F.sort_array(a), counted)


def frequencies(a: Column) -> Column:
    """array<struct<n, v>> of a list's values, most frequent first, equal ones by value."""
    counted = _runs(a)
    return F.array_sort(counted, lambda p, q: F.when(p["n"] > q["n"], -1).when(p["n"] < q["n"], 1).when(p["v"] < q["v"], -1).when(p["v"] > q["v"], 1).otherwise(0))


def top_text(a: Column, n: int, as_text) -> Column:
    """The n most frequent values as one text, padded with NULL."""
    picked = F.transform(F.slice(frequencies(a), 1, n), lambda e: as_text(e["v"]))
    return F.array_join(F.slice(F.concat(picked, F.array_repeat(F.lit("NULL"), n)), 1, n), ",")


def over_list(agg: str, a: Column, current: Column | None = None) -> Column:
    """An aggregate of a list without nulls. current: the row's own value, for count and ratio."""
    n = F.size(a)
    if agg == "sum":
        return F.when(n > 0, _total(a))
    if agg == "avg":
        return F.when(n > 0, _total(a) / n)
    if agg == "min":
        return F.array_min(a)
    if agg == "max":
        return F.array_max(a)
    if agg == "unique_count":
        return F.size(F.array_distinct(a)).cast("long")
    if agg == "count":
        return F.when(current.isNotNull(), F.size(F.filter(a, lambda x: x == current)).cast("long"))
    if agg == "ratio":
        return F.when(current.isNotNull() & (n > 0), F.size(F.filter(a, lambda x: x == current)) / n)
    if agg == "top1_ratio":
        return let(a, lambda b: F.when(F.size(b) > 0, F.array_max(F.transform(_runs(b), lambda e: e["n"])) / F.size(b)))
    if agg == "std":
        mean = _total(a) / n
        return F.when(n > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (n - 1)))
    raise ValueError(f"unknown aggregate {agg}")


def over_frame(agg: str, c: Column, w: WindowSpec) -> Column:
    """An aggregate of a column over a frame Spark knows."""
    native = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    if agg in native:
        return native[agg](c.cast("double") if agg in ("sum", "avg", "std") else c).over(w)
    if agg == "unique_count":
        return F.size(F.collect_set(c).over(w)).cast("long")
    return over_list(agg, F.collect_list(c).over(w), c)


def window_result(agg: str, value: Column, mode: str) -> Column:
    return F.coalesce(value, F.lit(0.0)) if agg == "sum" and mode == "runtime" else value


def golden_multi(agg: str, value: Column, n: Column, values: Column | None, default: Column, as_text) -> Column:
    """Adds the placeholder (the type's default, standing for the main row) to an aggregate over n side values."""
    if agg == "sum":
        return F.coalesce(value, F.lit(0.0))
    if agg == "avg":
        return F.coalesce(value * n, F.lit(0.0)) / (n + 1)
    if agg == "min":
        return F.least(value, default)
    if agg == "max":
        return F.greatest(value, default)
    if agg == "count":
        return F.when(n > 0, n + 1)
    if agg == "unique_count":
        return (F.size(F.array_distinct(F.concat(values, F.array(default))))).cast("long")
    if agg == "top3frequency":
        return top_text(F.concat(values, F.array(default)), 3, as_text)
    return value


def runtime_multi(agg: str, value: Column, n: Column, values: Column | None, as_text) -> Column:
    if agg == "sum":
        return F.coalesce(value, F.lit(0.0))
    if agg == "count":
        return n
    if agg == "top3frequency":
        return F.when(F.size(values) > 0, top_text(values, 3, as_text))
    if agg == "unique_count":
        return F.size(F.array_distinct(values)).cast("long")
    return value


def number_text(c: Column) -> Column:
    """A number with six decimals."""
    return F.format_string("%.6f", c.cast("double"))

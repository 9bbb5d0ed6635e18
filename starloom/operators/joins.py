"""Joins that keep the main table's rows: direct, as-of and windowed union, each with at most one shuffle of the main rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..plans.frames import Frame
from .windows import micros, time_slices


def _last(side: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str) -> DataFrame:
    """One side row for each key, the last by order (then by the values): a map-side combined maximum, no sort."""
    ranked = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    picked = side.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*(F.col(k).alias(f"{prefix}k{i}") for i, k in enumerate(keys))).agg(F.max(ranked).alias("r"))
    return picked.select(*(f"{prefix}k{i}" for i in range(len(keys))), *(F.col(f"r.v{i}").alias(f"{prefix}{c}") for i, c in enumerate(values)))


def direct_join(main: DataFrame, side: DataFrame, on: list[tuple[str, str]], values: list[str], prefix: str, order: list[str] | None = None) -> DataFrame:
    """main with prefix+value of the side row with equal keys, the last by order where there are several. Null keys never match."""
    last = _last(side, [b for _, b in on], order or [], values, prefix)
    condition = [main[a] == last[f"{prefix}k{i}"] for i, (a, _) in enumerate(on)]
    return main.join(last, condition, "left").drop(*(f"{prefix}k{i}" for i in range(len(on))))


@dataclass(frozen=True)
class MultiFeature:
    """One aggregate of a side column over a frame before the main row's time.

    pieces: how a text is split into several values before aggregating: (), (sep,), (sep, kv, "key") or (sep, kv, "value").
    """

    name: str
    agg: str
    value: str
    frame: Frame
    pieces: tuple[str, ...] = ()


@dataclass(frozen=True)
class LastFeature:
    """The value in the latest side row before the main row; frame.high limits its age if the window is a duration."""

    name: str
    value: str
    frame: Frame | None = None


def _default(kind: str) -> Column:
    return F.lit("") if kind == "string" else F.to_timestamp(F.lit("2019-07-18 09:20:20")) if kind.startswith("timestamp") else F.to_date(F.lit("2019-07-18")) if kind == "date" else F.lit(0).cast(kind)


def _split_values(c: Column, pieces: tuple[str, ...]) -> Column:
    from ..functions import scalars as S

    if len(pieces) == 1:
        return S.split(c, pieces[0])
    if pieces[2] == "key":
        return S.split_key(c, pieces[0], pieces[1])
    return F.transform(S.split_value(c, pieces[0], pieces[1]), lambda x: x.try_cast("double"))


def union_windows(main: DataFrame, side: DataFrame, on: list[tuple[str, str]], times: tuple[str, str], features: list[MultiFeature | LastFeature], order: list[str] | None = None, mode: str = "golden", low: int = 0, sliced: bool = False) -> DataFrame:
    """main with as-of values and window aggregates of side, all for one lower bound low (microseconds).

    Main and side rows are dealt by key once and ordered by time, each main row standing low (in golden mode at least one
    microsecond) before its own time, so that a frame that ends at the current row ends at the bound. Row caps are frames over
    the running number of side rows. Null keys and times match nothing; every main row stays, once.
    sliced: also deal a key's rows by slices of time as long as the longest frame; side rows go to their own and the next
    slice. A key with a large share of the rows is then many tasks' work; it needs frames of bounded time.
    """
    shift = max(low, 1) if mode == "golden" else low
    names = main.columns
    columns = list(dict.fromkeys(f.value for f in features))
    order = order or []
    types = {c: side.schema[c].dataType.simpleString() for c in columns}
    keys = [f"__k{i}" for i in range(len(on))]
    left = main.select(F.struct(*(F.col(c) for c in names)).alias("__main"), *(F.col(a).alias(k) for k, (a, _) in zip(keys, on)), (micros(F.col(times[0])) - F.lit(shift)).alias("__us"), F.lit(1).alias("__is_main"))
    right = side.select(*(F.col(b).alias(k) for k, (_, b) in zip(keys, on)), micros(F.col(times[1])).alias("__us"), F.lit(0).alias("__is_main"), *(F.col(c).alias(f"__v_{c}") for c in columns), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
    right = right.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "__us"]))
    if sliced:
        if any(f.frame is None or f.frame.kind != "range" for f in features):
            raise ValueError("only frames of bounded time can be sliced")
        width = max(f.frame.high for f in features)
        left = left.withColumn("__slice", time_slices(F.col("__us"), width, False)[0]["number"])
        right = right.withColumn("__slice", F.explode(time_slices(F.col("__us"), width, True)["number"]))
        keys = [*keys, "__slice"]
    both = left.unionByName(right, allowMissingColumns=True)

    ties = [f"__o{i}" for i in range(len(order))]
    by_row = Window.partitionBy(*keys).orderBy("__us", "__is_main", *ties)
    by_time = Window.partitionBy(*keys).orderBy("__us")
    is_side = F.col("__is_main") == 0
    if any(isinstance(f, MultiFeature) and (f.frame.kind == "rows" or f.frame.capped) for f in features):
        both = both.withColumn("__seq", F.sum(1 - F.col("__is_main")).over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    by_seq = Window.partitionBy(*keys).orderBy("__seq")

    made: list[Column] = []
    ages = [f for f in features if isinstance(f, LastFeature)]
    if ages:
        row = F.struct(F.col("__us").alias("us"), *(F.col(f"__v_{c}").alias(f"v_{c}") for c in dict.fromkeys(f.value for f in ages)))
        if mode == "golden":
            made.append(F.last(F.when(is_side, row), ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, 0)).alias("__last"))
        else:  # the latest value of each column that is not missing
            for c in dict.fromkeys(f.value for f in ages):
                known = F.when(is_side & F.col(f"__v_{c}").isNotNull(), F.struct(F.col("__us").alias("us"), F.col(f"__v_{c}").alias(f"v_{c}")))
                made.append(F.last(known, ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__last_{c}"))
    finals: list[Column] = []
    for f in features:
        if isinstance(f, LastFeature):
            got = F.col("__last" if mode == "golden" else f"__last_{f.value}")
            value = got[f"v_{f.value}"]
            if f.frame is not None and f.frame.kind == "range":
                value = F.when(got["us"] > F.col("__us") + F.lit(shift) - F.lit(f.frame.high), value)
            finals.append(value.alias(f.name))
            continue
        c, frame = F.col(f"__v_{f.value}"), f.frame
        reach = frame.high - shift if mode == "golden" else frame.high - shift - 1
        cap = frame.max_rows if mode == "golden" else max(frame.max_rows - 1, 1)
        listed, n, plain = f"__l_{f.name}", f"__n_{f.name}", f"__p_{f.name}"
        if frame.kind == "rows":
            window = by_seq.rangeBetween(-(max(frame.high, 1) - 1), 0)
        elif frame.capped:
            window = by_seq.rangeBetween(-(cap - 1), 0)
        else:
            window = by_time.rangeBetween(-max(reach, 0), 0)
        simple = not frame.capped and not f.pieces and f.agg not in ("unique_count", "top3frequency")
        kind = types[f.value]
        if simple:
            value = F.when(is_side, c)
            made.append(F.count(value).over(window).alias(n))
            if f.agg != "count":
                made.append(A.over_frame(f.agg, value, window).alias(plain))
            values, number = None, F.col(n)
            result = F.col(plain) if f.agg != "count" else number
        else:
            made.append(F.collect_list(F.when(is_side, F.struct(F.col("__us").alias("t"), c.alias("v")))).over(window).alias(listed))
            seen = F.filter(F.col(listed), lambda e: e["v"].isNotNull())
            if frame.capped:
                seen = F.filter(seen, lambda e: e["t"] >= F.col("__us") - F.lit(max(reach, 0)))
            values = F.transform(seen, lambda e: e["v"])
            if f.pieces:
                values = F.filter(F.flatten(F.transform(values, lambda x: _split_values(x, f.pieces))), lambda x: x.isNotNull())
                kind = "double" if f.pieces[-1] == "value" else "string"
            number = F.size(values).cast("long")
            result = number if f.agg == "count" else None if f.agg == "top3frequency" else A.over_list(f.agg, values)
        as_text = A.number_text if kind in ("double", "float") else (lambda x: x.cast("string"))
        if mode == "golden":
            default = _default(kind)
            if f.agg in ("min", "max"):
                default = default.cast(kind)
            finals.append(A.golden_multi(f.agg, result, number, values, default, as_text).alias(f.name))
        else:
            finals.append(A.runtime_multi(f.agg, result, number, values, as_text).alias(f.name))
    rows = both.select("*", *made).where("__is_main = 1")
    return rows.select(*(F.col("__main")[c].alias(c) for c in names), *finals)


def semi_join_filter(side: DataFrame, main: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The side rows whose keys occur in main. on: (main column, side column). Null keys match nothing."""
    keys = main.select(*(F.col(a).alias(f"__f{i}") for i, (a, _) in enumerate(on)))
    return side.join(keys, [side[b] == keys[f"__f{i}"] for i, (_, b) in enumerate(on)], "left_semi")


def existence_filter(side: DataFrame, main: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The side rows each of whose key columns, taken alone, occurs in main: a superset of semi_join_filter for several keys."""
    for pair in on:
        side = semi_join_filter(side, main, [pair])
    return side

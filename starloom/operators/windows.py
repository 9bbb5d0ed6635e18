"""Window aggregates of the main table: every feature of one (key, time) in one select, so one shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import aggregates as A
from ..plans.frames import Frame


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time column of any kind."""
    return F.unix_micros(c.cast("timestamp"))


def time_slices(us: Column, width: int, history: bool) -> Column:
    """The slices of time a row belongs to: its own and, if asked for, the next one, where it is history."""
    own = F.floor(us / F.lit(max(width, 1) + 1)).cast("long")
    slices = [F.struct(own.alias("number"), F.lit(False).alias("history"))]
    if not history:
        return F.array(*slices)
    later = F.struct((own + 1).alias("number"), F.lit(True).alias("history"))
    return F.when(us.isNull(), F.array(*slices)).otherwise(F.array(*slices, later))  # rows without a time are in no other slice


@dataclass(frozen=True)
class WindowFeature:
    """One aggregate over a frame. value: the column it reads."""

    name: str
    agg: str
    value: str
    frame: Frame


def _rows(frame: Frame, mode: str) -> tuple[int, int]:
    """First and last row of a rows frame; the native scorer counts the current row among the rows."""
    return -(frame.high if mode == "golden" else max(frame.high - 1, frame.low)), -frame.low


def _range(frame: Frame, mode: str) -> tuple[int, int]:
    """The native scorer leaves out rows exactly at the far end."""
    return -(frame.high if mode == "golden" else frame.high - 1), -frame.low


def _cap(frame: Frame, mode: str) -> int:
    return frame.max_rows if mode == "golden" else max(frame.max_rows - 1, 1)


#: Aggregates of which the parts of a frame can be merged.
MERGED = ("sum", "avg", "min", "max")
_FIRST = Window.unboundedPreceding


def window_features(df: DataFrame, keys: list[str], time: str, features: list[WindowFeature], order: tuple[str, ...] = (), mode: str = "golden", sliced: bool = False) -> DataFrame:
    """df with the features. order: columns that decide between rows of equal time.

    sliced: also deal the rows of a key by slices of time as long as the longest frame, each row to its own slice and, as
    history, to the next one. That doubles the rows but spreads a key with a large share of them over many tasks; it needs
    range frames. Sums, means and extremes of frames without a row cap then take time in proportion to the rows (see _merged).

    A range frame without a row cap holds all rows of equal time. A capped one holds the latest max_rows rows up to the
    current row in (time, order) that are in the range; with a lower bound over zero, the latest of the range. Rows with a null key
    form a partition of their own; rows with a null time come last and see only each other in range frames.
    """
    if not features:
        return df
    us = "__us"
    names = df.columns
    df = df.withColumn(us, micros(F.col(time)))
    rest = features
    if sliced:
        if any(f.frame.kind != "range" for f in features):
            raise ValueError("only range frames can be sliced")
        merged: dict[tuple[int, int], list[WindowFeature]] = {}
        for f in features:
            if f.agg in MERGED and not f.frame.capped:
                merged.setdefault(_range(f.frame, mode), []).append(f)
        for reach, own in merged.items():
            df = _merged(df, keys, us, own, reach, mode)
        rest = [f for f in features if f.agg not in MERGED or f.frame.capped]
        if rest:
            df = df.withColumn("__slice", F.explode(time_slices(F.col(us), max(f.frame.high for f in rest), True)))
            df = df.withColumn("__history", F.col("__slice.history")).withColumn("__slice", F.col("__slice.number"))
            keys = [*keys, "__slice"]
    lists = [f for f in rest if f.agg not in ("count", "ratio")]
    df = _frames(df, keys, us, lists, order, mode) if lists else df
    equal = [f for f in rest if f.agg in ("count", "ratio")]
    df = _equal(df, keys, us, equal, order, mode) if equal else df
    if sliced and rest:
        df = df.where(~F.col("__history"))
    return df.select(*names, *(f.name for f in features))


def _merged(df: DataFrame, keys: list[str], us: str, features: list[WindowFeature], reach: tuple[int, int], mode: str) -> DataFrame:
    """Aggregates of one range frame in time linear in the rows, with no difference of sums, so nothing is lost by cancellation.

    Time is cut into slices as long as the frame, so a frame is the end of one slice and the start of the next. The start grows with
    the current row; the end grows backwards, once a row of the slice before is placed at the last time that still sees it. Where
    the frame ends before the current row, a row's values count from the later time at which it enters the frames.
    """
    low, high = reach
    length = max(high - low, 0)
    t, enters = F.col(us), F.col(us) - F.lit(high)
    own = F.floor(enters / F.lit(length + 1)).cast("long")
    role = lambda number, at, asks, starts, ends: F.struct(number.alias("number"), at.alias("at"), F.lit(asks).alias("asks"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))
    roles = [role(own + 1, enters + F.lit(length), False, False, True)]
    if high == 0:
        roles.append(role(own, t, True, True, False))
    else:
        roles += [role(F.floor(t / F.lit(length + 1)).cast("long"), t, True, False, False), role(own, enters, False, True, False)]
    alone = F.array(role(F.lit(None).cast("long"), F.lit(None).cast("long"), True, True, False))  # without a time: all such rows of the key
    names = df.columns
    df = df.withColumn("__role", F.explode(F.when(t.isNull(), alone).otherwise(F.array(*roles)))).select(*names, "__role.*")
    w = Window.partitionBy(*keys, "number").rangeBetween(_FIRST, Window.currentRow)
    sides = {"s": (F.col("starts"), w.orderBy(F.col("at").asc_nulls_last())), "e": (F.col("ends"), w.orderBy(F.col("at").desc_nulls_last()))}
    for side, (counts, window) in sides.items():
        parts = []
        for f in features:
            x = F.when(counts, F.col(f.value).cast("double") if f.agg in ("sum", "avg") else F.col(f.value))
            parts.append({"min": F.min, "max": F.max}.get(f.agg, F.sum)(x).over(window).alias(f"{f.name}_{side}"))
            if f.agg == "avg":
                parts.append(F.count(x).over(window).alias(f"{f.name}_n{side}"))
        df = df.select("*", *parts)
    out = []
    for f in features:
        a, b = F.col(f"{f.name}_s"), F.col(f"{f.name}_e")
        both = F.coalesce(a + b, a, b)
        result = {"min": F.least(a, b), "max": F.greatest(a, b)}.get(f.agg, both)
        if f.agg == "avg":
            result = F.try_divide(both, F.col(f"{f.name}_ns") + F.col(f"{f.name}_ne"))
        out.append(A.window_result(f.agg, result, mode).alias(f.name))
    return df.where("asks").select(*names, *out)


def _frames(df: DataFrame, keys: list[str], us: str, features: list[WindowFeature], order: tuple[str, ...], mode: str) -> DataFrame:
    """All aggregates but count and ratio. Each frame is listed once, whatever the number of its features, and its lists end before
    the next sort: first the frames that need the total order, then those by time, which that order serves too."""
    by_time = Window.partitionBy(*keys).orderBy(F.col(us).asc_nulls_last())
    total = Window.partitionBy(*keys).orderBy(F.col(us).asc_nulls_last(), *order)
    in_total = lambda f: f.frame.kind == "rows" or f.frame.capped and f.frame.low == 0
    for own in ([f for f in features if in_total(f)], [f for f in features if not in_total(f)]):
        if not own:
            continue
        names = df.columns
        capped = [f for f in own if f.frame.capped]
        values = list(dict.fromkeys(f.value for f in capped))
        at = {v: f"v{i}" for i, v in enumerate(values)}
        frames = {frame: f"__list{i}" for i, frame in enumerate(dict.fromkeys(f.frame for f in capped))}
        lists = [_listed(frame, by_time, total, us, order, [F.col(v).alias(a) for v, a in at.items()], mode).alias(n) for frame, n in frames.items()]
        plain = []
        for f in own:
            if not f.frame.capped:
                w = total.rowsBetween(*_rows(f.frame, mode)) if f.frame.kind == "rows" else by_time.rangeBetween(*_range(f.frame, mode))
                plain.append(A.window_result(f.agg, A.over_frame(f.agg, F.col(f.value), w), mode).alias(f.name))
        df = df.select(*names, *plain, *lists)
        if capped:
            names = [n for n in df.columns if n not in frames.values()]
            pairs = {(f.frame, f.value): f"{frames[f.frame]}_{at[f.value]}" for f in capped}
            df = df.select(*names, *(_inside(frame, F.col(n), us, mode).alias(n) for frame, n in frames.items()))
            df = df.select(*names, *(F.filter(F.col(frames[frame])[at[v]], lambda x: x.isNotNull()).alias(n) for (frame, v), n in pairs.items()))
            df = df.select(*names, *(A.window_result(f.agg, A.over_list(f.agg, F.col(pairs[f.frame, f.value]), F.col(f.value)), mode).alias(f.name) for f in capped))
    return df


def _listed(frame: Frame, by_time: WindowSpec, total: WindowSpec, us: str, order: tuple[str, ...], values: list[Column], mode: str) -> Column:
    """The rows a capped frame is cut from, as a list of structs."""
    if frame.low == 0:
        return F.collect_list(F.struct(F.col(us).alias("t"), *values)).over(total.rowsBetween(-(_cap(frame, mode) - 1), 0))
    seen = F.struct(F.col(us).alias("t"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *values)
    seen = F.collect_list(seen).over(by_time.rangeBetween(*_range(frame, mode)))
    return F.array_sort(seen) if order else seen


def _inside(frame: Frame, rows: Column, us: str, mode: str) -> Column:
    cap = _cap(frame, mode)
    if frame.low == 0:
        return F.filter(rows, lambda e: e["t"] >= F.col(us) + _range(frame, mode)[0])
    return F.slice(rows, F.greatest(F.size(rows) - cap + 1, F.lit(1)), cap)


def _equal(df: DataFrame, keys: list[str], us: str, features: list[WindowFeature], order: tuple[str, ...], mode: str) -> DataFrame:
    """count and ratio: how many rows of a frame have the current row's value, as differences of running counts, which are exact.

    In (time, order) a frame is a run of rows, so its rows of a value are those up to its end without those up to its start. Both ends
    are a time, a distance in rows, or, where both bind, the later start. No lists are made, and every frame takes time in
    proportion to the rows. hi, lo: running counts at the ends; a...: of all values; l...: of the row's own.
    """
    t, place = F.col(us), "__place"
    by_time = Window.partitionBy(*keys).orderBy(t.asc_nulls_last())
    total = Window.partitionBy(*keys).orderBy(t.asc_nulls_last(), *order)

    def until(x: Column, w: WindowSpec, end: int) -> Column:
        """Rows with a time up to end away; for rows without a time, which come last: all rows."""
        return F.count(x).over(w.rangeBetween(_FIRST, end))

    def before(x: Column, w: WindowSpec, start: int) -> Column:
        """Rows with a time before start; for rows without a time: all rows that have one."""
        return F.when(t.isNull(), F.count(F.when(t.isNotNull(), x)).over(w.rangeBetween(_FIRST, Window.currentRow))).otherwise(until(x, w, start - 1))

    names = df.columns
    first: list[Column] = [F.row_number().over(total).cast("long").alias(place)]
    timed, by_place, by_value, far = [], [], [], []
    hi: dict[str, Column] = {}
    lo: dict[str, Column] = {}
    for i, f in enumerate(features):
        c, like = F.col(f.value), Window.partitionBy(*keys, f.value)
        near, when = like.orderBy(place), like.orderBy(t.asc_nulls_last())
        ratio = f.agg == "ratio"
        put = lambda stage, kind, x, i=i: stage.append(x.alias(f"__{kind}{i}"))
        get = lambda *kinds, i=i: F.greatest(*(F.col(f"__{k}{i}") for k in kinds)) if len(kinds) > 1 else F.col(f"__{kinds[0]}{i}")
        frame = f.frame
        if frame.kind == "rows":
            a, b = _rows(frame, mode)
            put(by_place, "lhi", F.count(c).over(near.rangeBetween(_FIRST, b)))
            put(by_place, "llo", F.count(c).over(near.rangeBetween(_FIRST, a - 1)))
            if ratio:
                put(first, "ahi", F.count(c).over(total.rowsBetween(_FIRST, b)))
                put(first, "alo", F.count(c).over(total.rowsBetween(_FIRST, a - 1)))
            los = ("lo",)
        elif not frame.capped:
            a, b = _range(frame, mode)
            put(by_value, "lhi", until(c, when, b))
            put(by_value, "llo", before(c, when, a))
            if ratio:
                put(timed, "ahi", until(c, by_time, b))
                put(timed, "alo", before(c, by_time, a))
            los = ("lo",)
        elif frame.low == 0:
            a, cap = _range(frame, mode)[0], _cap(frame, mode)
            put(by_place, "lhi", F.count(c).over(near.rangeBetween(_FIRST, 0)))
            put(by_place, "llo", F.count(c).over(near.rangeBetween(_FIRST, -cap)))
            put(by_value, "ltime", F.when(t.isNull(), F.col(f"__lhi{i}")).otherwise(until(c, when, a - 1)))  # without a time: not even the row itself
            if ratio:
                put(first, "ahi", F.count(c).over(total.rowsBetween(_FIRST, 0)))
                put(first, "alo", F.count(c).over(total.rowsBetween(_FIRST, -cap)))
                put(timed, "atime", F.when(t.isNull(), F.col(f"__ahi{i}")).otherwise(until(c, by_time, a - 1)))
            los = ("lo", "time")
        else:
            (a, b), cap = _range(frame, mode), _cap(frame, mode)
            put(timed, "end", until(F.lit(1), by_time, b))
            put(timed, "start", before(F.lit(1), by_time, a))
            put(by_value, "lhi", until(c, when, b))
            put(by_value, "ltime", before(c, when, a))
            far.append((i, f, cap))
            if ratio:
                put(first, "acap", F.count(c).over(total.rowsBetween(_FIRST, -cap)))
                put(timed, "ahi", until(c, by_time, b))
                put(timed, "atime", before(c, by_time, a))
                put(timed, "alo", F.max(f"__acap{i}").over(by_time.rangeBetween(_FIRST, b)))  # that of the frame's last row
            los = ("lo", "time")
        hi[f.name], lo[f.name] = get("lhi"), get(*(f"l{k}" for k in los))
        if ratio:
            hi[f.name + "/"], lo[f.name + "/"] = get("ahi"), get(*(f"a{k}" for k in los))
    for stage in (first, timed):
        df = df.select("*", *stage)
    if far:  # only a key with a frame over its cap has rows to be counted up to a place that no other row fixes
        df = df.select("*", *(F.max(F.col(f"__end{i}") - F.col(f"__start{i}") > cap).over(Window.partitionBy(*keys)).alias(f"__far{i}") for i, _, cap in far))
    for stage in (by_place, by_value):
        df = df.select("*", *stage)
    for i, f, cap in far:
        copies = F.when(F.col(f"__far{i}") & F.col(f.value).isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        df = df.withColumn("__copy", F.explode(copies)).withColumn("__at", F.when(F.col("__copy"), F.col(place) + cap).otherwise(F.col(f"__end{i}")))
        w = Window.partitionBy(*keys, f.value).orderBy("__at").rangeBetween(_FIRST, Window.currentRow)
        df = df.select("*", F.count(F.when(F.col("__copy"), F.lit(1))).over(w).alias(f"__llo{i}")).where(~F.col("__copy")).drop("__copy", "__at")
    out = []
    for f in features:
        n = hi[f.name] - lo[f.name]
        if f.agg == "ratio":
            n = F.try_divide(n, hi[f.name + "/"] - lo[f.name + "/"])
        out.append(F.when(F.col(f.value).isNotNull(), n).alias(f.name))
    return df.select(*names, *out)

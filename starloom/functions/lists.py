"""Functions over the values of a window, as lists: filter, group, rank, pick and join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .aggregates import frequencies


def where(values: Column, keep: Callable[[Column], Column]) -> Column:
    """The values that satisfy a condition."""
    return F.filter(values, keep)


def foreach(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(values, f)


def group_by(values: Column) -> Column:
    """map of value to its count; nulls are left out."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.map_from_entries(F.transform(frequencies(known), lambda e: F.struct(e["v"], e["n"])))


def sort_by_value(counts: Column) -> Column:
    """The keys of a map of counts, largest count first, equal ones by key."""
    order = F.array_sort(F.map_entries(counts), lambda p, q: F.when(p["value"] > q["value"], -1).when(p["value"] < q["value"], 1).when(p["key"] < q["key"], -1).when(p["key"] > q["key"], 1).otherwise(0))
    return F.transform(order, lambda e: e["key"])


def take(values: Column, start: int, end: int) -> Column:
    """The values from position start (0 is the first) up to end."""
    return F.slice(values, start + 1, end - start)


def first(values: Column) -> Column:
    """The first value; null for an empty list."""
    return F.get(values, 0)


def top(values: Column, n: int = 1) -> Column:
    """The n largest values, largest first."""
    return F.slice(F.sort_array(values, asc=False), 1, n)


def at(values: Column, i: int) -> Column:
    """The i-th most recent value of a window listed by time; 0 is the current row's."""
    return F.get(values, F.size(values) - 1 - i)


def count_where(values: Column, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, keep)).cast("long")


def count_of_window(values: Column) -> Column:
    return F.size(values).cast("long")


def split_by_key(text: Column, sep: str, kv: str) -> Column:
    """A key-value text as a map; of repeated keys the first counts."""
    from .scalars import split, split_value

    keys = F.transform(split(text, sep), lambda e: F.split_part(e, F.lit(kv), F.lit(1)))
    values = split_value(text, sep, kv)
    unique = F.array_distinct(keys)
    return F.map_from_arrays(unique, F.transform(unique, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)))


def get_keys(m: Column) -> Column:
    return F.map_keys(m)


def get_values(m: Column) -> Column:
    return F.map_values(m)

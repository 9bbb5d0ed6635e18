"""Scalar functions: arithmetic, dates, membership, crossing and splitting. A missing argument makes the result missing."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(*x: Column) -> Column:
    return functools.reduce(operator.add, x)


def multiply(*x: Column) -> Column:
    return functools.reduce(operator.mul, x)


def subtract(a: Column, b: Column) -> Column:
    return a - b


def divide(a: Column, b: Column) -> Column:
    """Null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log(x: Column) -> Column:
    """Natural logarithm; null unless x is over zero."""
    return F.when(x > 0, F.ln(x.cast("double")))


def moment(x: Column) -> Column:
    return x.cast("timestamp")


def dayofweek(x: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(moment(x))


def isweekday(x: Column) -> Column:
    """1 from Monday to Friday, else 0."""
    return F.when(x.isNotNull(), F.dayofweek(moment(x)).between(2, 6).cast("int"))


def hourofday(x: Column) -> Column:
    return F.hour(moment(x))


def timediff(a: Column, b: Column, unit: str = "SECOND") -> Column:
    """Whole units from b to a."""
    return F.timestamp_diff(unit, moment(b), moment(a))


def isin(x: Column, values: Column) -> Column:
    """1 if the text of x is in an array of texts, 0 if not or if the array is missing; null if x is."""
    return F.when(x.isNotNull(), F.coalesce(F.array_contains(values, x.cast("string")), F.lit(False)).cast("int"))


def text(x: Column) -> Column:
    return x.cast("string")


def combine(x: list[Column], arrays: list[bool]) -> Column:
    """Crosses categories as texts joined by commas; crossing with a multi-valued argument gives one text for each of its values.

    Of two arguments a missing one is left out; of three all are needed.
    """
    if not any(arrays):
        parts = [text(c) for c in x]
        joined = F.concat_ws(",", *parts)
        if len(parts) == 2:
            return F.when(F.coalesce(*parts).isNotNull(), joined)
        return F.when(functools.reduce(operator.and_, (p.isNotNull() for p in parts)), joined)
    lists = [c if a else F.when(c.isNotNull(), F.array(text(c))) for c, a in zip(x, arrays)]

    def cross(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.concat_ws(",", p, q))))

    out = lists[0]
    for other in lists[1:]:
        both = cross(out, other)
        out = F.coalesce(both, out, other) if len(lists) == 2 else both
    return out


def separator(code: str) -> str:
    """The character of an ASCII code."""
    return chr(int(code))


def _quoted(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def split(x: Column, sep: str) -> Column:
    return F.split(text(x), _quoted(sep))


def split_key(x: Column, sep: str, kv: str) -> Column:
    """The keys of a key-value text, as a list."""
    return F.transform(split(x, sep), lambda e: F.split_part(e, F.lit(kv), F.lit(1)))


def split_value(x: Column, sep: str, kv: str) -> Column:
    """The values of a key-value text; null for an element without a value."""
    return F.transform(split(x, sep), lambda e: F.when(F.contains(e, F.lit(kv)), F.split_part(e, F.lit(kv), F.lit(2))))


#: Labels' values where the source has none, by storage type.
LABEL_DEFAULTS = {"string": "0", "boolean": False, "int": 0, "smallint": 0, "bigint": 0, "long": 0, "double": 0.0, "float": 0.0}


def label(x: Column, feature_type: str) -> Column:
    if feature_type not in LABEL_DEFAULTS:
        raise ValueError(f"a {feature_type} cannot be a label")
    return F.coalesce(x, F.lit(LABEL_DEFAULTS[feature_type]))


def continuous(x: Column) -> Column:
    """The numeric signature of a feature."""
    return x.try_cast("double")


def discrete(x: Column, is_array: bool = False) -> Column:
    """The categorical signature of a feature: a 64-bit hash of its text, or of each of its texts."""
    if is_array:
        return F.transform(x, lambda e: F.xxhash64(e.cast("string")))
    return F.when(x.isNotNull(), F.xxhash64(text(x)))


def join_window(values: Column, sep: str = ",", null_text: str = "NULL") -> Column:
    """The texts of a list in one text."""
    return F.array_join(F.transform(values, text), sep, null_text)

"""Declared entities, columns and relations of a star schema, read from the feature-info JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Storage types and their Spark types.
STORAGE = {
    "string": T.StringType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}
NUMERIC = {"smallint", "int", "bigint", "long", "float", "double"}


class SchemaError(ValueError):
    """A configuration that does not describe a star schema."""


@dataclass(frozen=True)
class Column:
    """One declared column. data_type is its meaning: how it may be used as a feature."""

    table: str
    name: str
    feature_type: str
    data_type: str = "SingleString"
    skip: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return STORAGE[self.feature_type]

    @property
    def is_numeric(self) -> bool:
        return self.feature_type in NUMERIC

    @property
    def separators(self) -> tuple[str, ...]:
        """Separators of a multi-valued column: ArrayString(,) has one, KVString(,)[:] two."""
        head, _, rest = self.data_type.partition("(")
        if head not in ("ArrayString", "KVString", "KVNum"):
            return ()
        first, _, second = rest.partition(")")
        return (first, second.strip("[]")) if second else (first,)

    @property
    def kind(self) -> str:
        """ignore, label, time, numeric, category or multi."""
        head = self.data_type.partition("(")[0]
        if self.skip or head == "SplitID":
            return "ignore"
        if head in ("Label", "DiscreteLabel", "ContinueLabel"):
            return "label"
        if head in ("Timestamp", "Date"):
            return "time"
        if head == "ContinueNum":
            return "numeric"
        if head in ("ArrayString", "KVString", "KVNum"):
            return "multi"
        if head in ("SingleString", "DiscreteNum"):
            return "category"
        raise SchemaError(f"{self.table}.{self.name}: unknown data_type {self.data_type}")


@dataclass(frozen=True)
class Relation:
    """An edge from the target entity to a side table: 1-1, SLICE (as-of) or 1-M (windowed)."""

    type: str
    from_entity: str
    from_keys: tuple[str, ...]
    to_entity: str
    to_keys: tuple[str, ...]
    from_time: str = ""
    to_time: str = ""
    windows: tuple[str, ...] = ()
    delay: str = ""
    #: Columns that decide which side row comes last among equal times (and, for 1-1, altogether).
    order: tuple[str, ...] = ()

    @property
    def is_direct(self) -> bool:
        return self.type == "1-1"


@dataclass(frozen=True)
class Schema:
    target: str
    index: str
    pivot_time: str
    label: str
    tables: dict[str, tuple[Column, ...]]
    relations: tuple[Relation, ...] = field(default=())

    def column(self, table: str, name: str) -> Column:
        for c in self.tables.get(table, ()):
            if c.name == name:
                return c
        raise SchemaError(f"unknown column {table}.{name}")

    def struct(self, table: str) -> T.StructType:
        """The explicit schema for reading a table that carries none."""
        return T.StructType([T.StructField(c.name, c.spark_type) for c in self.tables[table]])

    def relation(self, table: str, *types: str) -> Relation:
        for r in self.relations:
            if r.to_entity == table and r.type in types:
                return r
        raise SchemaError(f"no relation of type {' or '.join(types)} to {table}")

    def validate(self, table: str, found: T.StructType) -> None:
        """Raises if a table lacks a declared column or holds it in a type that is not of the declared family."""
        have = {f.name.lower(): f.dataType for f in found.fields}
        for c in self.tables[table]:
            if c.name.lower() not in have:
                raise SchemaError(f"{table} has no column {c.name}")
            t = have[c.name.lower()]
            number = isinstance(t, (T.NumericType, T.BooleanType))
            moment = isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))
            if c.is_numeric and not number or c.feature_type in ("timestamp", "date") and not moment:
                raise SchemaError(f"{table}.{c.name} is {t.simpleString()}, declared {c.feature_type}")


def _truth(x) -> bool:
    return x if isinstance(x, bool) else str(x).lower() == "true"


def load_schema(config: str | dict) -> Schema:
    """The schema of a feature-info configuration (its text or parsed JSON)."""
    data = json.loads(config) if isinstance(config, str) else config
    info = data.get("app", data).get("feature_info", data)
    if "entity_detail" not in info:
        raise SchemaError("entity_detail is missing")
    tables = {}
    for table, detail in info["entity_detail"].items():
        columns = []
        for f in detail["features"]:
            owner, _, name = f["id"].rpartition(".")
            kind = str(f.get("feature_type", "string")).lower()
            if kind not in STORAGE:
                raise SchemaError(f"{f['id']}: unknown feature_type {kind}")
            columns.append(Column(owner or table, name, kind, f.get("data_type", "SingleString"), _truth(f.get("skip", False))))
            columns[-1].kind  # noqa: B018  raises on unknown meanings
        tables[table] = tuple(columns)
    target = info["target_entity"]
    relations = []
    for r in info.get("relations", []):
        if r["from_entity"] != target:
            raise SchemaError("relations start at the target entity only")
        if r["type"] not in ("1-1", "SLICE", "1-M", "M-1", "M-M"):
            raise SchemaError(f"unknown relation type {r['type']}")
        kind = "1-1" if r["type"][2:3] == "1" else r["type"]
        if len(r["from_entity_keys"]) != len(r["to_entity_keys"]):
            raise SchemaError(f"keys of the relation to {r['to_entity']} differ in number")
        relations.append(
            Relation(kind, target, tuple(r["from_entity_keys"]), r["to_entity"], tuple(r["to_entity_keys"]), r.get("from_entity_time_col") or "", r.get("to_entity_time_col") or "", tuple(r.get("time_windows") or ()), r.get("window_delay") or "", tuple(r.get("order_by") or ()))
        )
    label = (info.get("target_label") or "").rpartition(".")[2]
    return Schema(target, (info.get("target_entity_index") or "").rpartition(".")[2], (info.get("target_pivot_timestamp") or "").rpartition(".")[2], label, tables, tuple(relations))

"""Plans a feature program as one DataFrame.

Operators are grouped by scope: one direct join for each 1-1 relation, one union for each windowed relation and lower bound,
one select for each (key, time) of the main table; scalar functions become columns of the final select. A call that occurs
several times is planned once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..operators.joins import LastFeature, MultiFeature, direct_join, union_windows
from ..operators.prep import hot_keys
from ..operators.windows import WindowFeature, window_features
from .dsl import Call, Token, parse_program
from .frames import parse_frame
from .schema import Column, Schema


class PlanError(ValueError):
    """A program that the schema cannot serve."""


class UnknownOperator(PlanError):
    """A name that is no operator."""


SPLITS = {"split": 1, "split_key": 2, "split_value": 2}
ARITHMETIC = {"add": S.add, "multiply": S.multiply, "subtract": S.subtract, "divide": S.divide}
UNARY = {"log": S.log, "dayofweek": S.dayofweek, "isweekday": S.isweekday, "hourofday": S.hourofday}
LABELS = ("binary_label", "regression_label")
SIGNATURES = ("continuous", "discrete")
CASTS = ("double", "float", "int", "bigint", "timestamp", "date", "string")
WINDOW_OPS = {f"window_{a}": a for a in A.WINDOW}
MULTI_OPS = {f"multi_{a}": a for a in A.MULTI}
OPERATORS = {"original", "column", "output", "multi_direct", "multi_last_value", *WINDOW_OPS, *MULTI_OPS, *ARITHMETIC, *UNARY, "timediff", "isin", "combine", "ifnull", "isnull", "if", *SPLITS, *LABELS, *SIGNATURES, *CASTS}


@dataclass(frozen=True)
class Value:
    """A planned argument. storage: its declared type; is_array: a list of texts or numbers."""

    column: SparkColumn
    storage: str
    is_array: bool = False


def feature_name(call: Call) -> str:
    return re.sub(r"_+", "_", re.sub(r"\W", "_", str(call))).strip("_")


def _scoped(call: Call) -> str | None:
    if call.name in ("multi_direct", "multi_last_value"):
        return "join"
    if call.name in MULTI_OPS:
        return "multi"
    return "window" if call.name in WINDOW_OPS else None


def strict_filter(program: list[Call], schema: Schema) -> list[Call]:
    """The lines that the text generators keep: numeric aggregates over numbers, no window_ with multi_ operators in a line, and
    no joined values under window, date, log or top-3 operators."""
    kept = []
    for line in program:
        inside = list(line.calls())
        names = {c.name for c in inside}
        numeric = all(_is_numeric(c, schema) for c in inside if (WINDOW_OPS.get(c.name) or MULTI_OPS.get(c.name)) in A.NUMERIC)
        mixed = any(_scoped(c) == "window" for c in inside) and any(_scoped(c) in ("multi", "join") for c in inside)
        late = {"multi_direct", "multi_last_value"} & names and ({*UNARY, "multi_top3frequency"} & names or any(n.startswith("window_") for n in names))
        if numeric and not mixed and not late:
            kept.append(line)
    return kept


def _is_numeric(call: Call, schema: Schema) -> bool:
    arg = call.args[-1] if call.name in WINDOW_OPS else call.args[1]
    if isinstance(arg, Call):
        return arg.name in SPLITS or arg.name in ARITHMETIC or arg.name in UNARY
    table, _, name = arg.text.partition(".")
    return schema.column(table, name).is_numeric


class Planner:
    def __init__(self, schema: Schema, tables: dict[str, DataFrame], mode: str = "golden", order: tuple[str, ...] = (), sliced: bool | str = False, hot_share: float = 0.01):
        """order: main columns that decide between main rows of equal time in row frames. sliced: deal keys by slices of time
        too wherever all frames of a scope are bounded in time, for keys that hold a large share of the rows; "auto" counts the
        rows of each key and does so where one has more than hot_share of them."""
        if mode not in ("golden", "runtime"):
            raise PlanError(f"unknown mode {mode}")
        self.schema, self.tables, self.mode, self.order, self.sliced, self.hot_share = schema, tables, mode, order, sliced, hot_share
        self.names: dict[Call, str] = {}
        for name, df in tables.items():
            if name in schema.tables:
                schema.validate(name, df.schema)

    def _column(self, token: Token, main_only: bool = True) -> Column:
        table, dot, name = token.text.partition(".")
        if not dot:
            raise PlanError(f"{token} is not table.column")
        if main_only and table != self.schema.target:
            raise PlanError(f"{token} is not a column of the main table")
        return self.schema.column(table, name)

    def plan(self, program: str | list[Call], names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
        """The main table's index (or the columns of keep) and one column for each line."""
        lines = parse_program(program) if isinstance(program, str) else program
        names = names or [feature_name(x) for x in lines]
        if len(set(names)) != len(lines):
            raise PlanError("each line needs a name of its own")
        for line in lines:
            for c in line.calls():
                if c.name not in OPERATORS:
                    raise UnknownOperator(c.name)
        keep = keep if keep is not None else [self.schema.index] if self.schema.index else []
        df = self.tables[self.schema.target]
        needed = self._needed(lines, keep)
        df = self._scopes(df.select(*(c for c in df.columns if c in needed)), lines)
        return df.select(*keep, *(self._value(line).column.alias(n) for line, n in zip(lines, names)))

    def _needed(self, lines: list[Call], keep: list[str]) -> set[str]:
        """The main table's columns that the program reads: only these travel through unions and windows."""
        pairs = [str(a).partition(".")[::2] for line in lines for c in line.calls() for a in c.args if isinstance(a, Token)]
        tables = {t for t, _ in pairs}
        related = [r for r in self.schema.relations if r.to_entity in tables]
        return {*keep, *self.order, *(n for t, n in pairs if t == self.schema.target), *(k for r in related for k in (*r.from_keys, r.from_time))}

    # scopes

    def _scopes(self, df: DataFrame, lines: list[Call]) -> DataFrame:
        found = list(dict.fromkeys(c for line in lines for c in line.calls() if _scoped(c)))
        self.names = {c: f"__f{i}" for i, c in enumerate(found)}
        df = self._direct(df, [c for c in found if c.name == "multi_direct"])
        df = self._unions(df, [c for c in found if c.name == "multi_last_value" or c.name in MULTI_OPS])
        return self._windows(df, [c for c in found if c.name in WINDOW_OPS])

    def _main_argument(self, call: Call) -> None:
        if not isinstance(call.args[0], Token) or call.args[0].text != self.schema.target:
            raise PlanError(f"{call}: the first argument is the main table")

    def _direct(self, df: DataFrame, calls: list[Call]) -> DataFrame:
        by_table: dict[str, list[Call]] = {}
        for c in calls:
            self._main_argument(c)
            by_table.setdefault(self._column(c.args[1], False).table, []).append(c)
        for table, own in by_table.items():
            r = self.schema.relation(table, "1-1")
            values = [self._column(c.args[1], False).name for c in own]
            prefix = f"__d_{table}_"
            order = list(r.order) or ([r.to_time] if r.to_time else [])
            df = direct_join(df, self.tables[table], list(zip(r.from_keys, r.to_keys)), list(dict.fromkeys(values)), prefix, order)
            df = df.withColumns({self.names[c]: F.col(prefix + v) for c, v in zip(own, values)}).drop(*(prefix + v for v in values))
        return df

    def _unions(self, df: DataFrame, calls: list[Call]) -> DataFrame:
        groups: dict[tuple, list] = {}
        for c in calls:
            self._main_argument(c)
            frame = parse_frame(str(c.args[2]))
            arg, pieces = c.args[1], ()
            if isinstance(arg, Call):
                if arg.name not in SPLITS:
                    raise PlanError(f"{c}: {arg.name} cannot be aggregated over a side table")
                codes = tuple(S.separator(str(x)) for x in arg.args[1:])
                pieces = codes if arg.name == "split" else (*codes, arg.name.removeprefix("split_"))
                arg = arg.args[0]
            column = self._column(arg, False)
            if c.name == "multi_last_value":
                r = self.schema.relation(column.table, "SLICE", "1-M")
                feature = LastFeature(self.names[c], column.name, frame)
                low = 0
            else:
                agg = MULTI_OPS[c.name]
                if agg in A.NUMERIC and not (column.is_numeric and not pieces or pieces and pieces[-1] == "value"):
                    raise PlanError(f"{c}: {agg} needs numbers")
                r = self.schema.relation(column.table, "1-M", "SLICE")
                feature = MultiFeature(self.names[c], agg, column.name, frame, pieces)
                low = frame.low if frame.kind == "range" else 0
            groups.setdefault((r, low), []).append(feature)
        for (r, low), features in groups.items():
            df = union_windows(df, self.tables[r.to_entity], list(zip(r.from_keys, r.to_keys)), (r.from_time, r.to_time), features, list(r.order), self.mode, low, self._slices(features, r.to_entity, r.to_keys))
        return df

    def _slices(self, features: list, table: str, keys: tuple[str, ...]) -> bool:
        if not self.sliced or not all(f.frame is not None and f.frame.kind == "range" for f in features):
            return False
        return self.sliced != "auto" or bool(hot_keys(self.tables[table], keys, self.hot_share).head(1))

    def _windows(self, df: DataFrame, calls: list[Call]) -> DataFrame:
        groups: dict[tuple, list[WindowFeature]] = {}
        made = {}
        for c in calls:
            if len(c.args) != 4:
                raise PlanError(f"{c}: time, key, window and value are needed")
            time, key = self._column(c.args[0]), self._column(c.args[1])
            agg, value = WINDOW_OPS[c.name], c.args[3]
            if agg in A.NUMERIC and not _is_numeric(c, self.schema):
                raise PlanError(f"{c}: {agg} needs numbers")
            if isinstance(value, Token):
                name = self._column(value).name
            else:
                name = f"{self.names[c]}_v"
                made[name] = self._value(value).column
            groups.setdefault((key.name, time.name), []).append(WindowFeature(self.names[c], agg, name, parse_frame(str(c.args[2]))))
        if made:
            df = df.withColumns(made)
        for (key, time), features in groups.items():
            df = window_features(df, [key], time, features, self.order, self.mode, self._slices(features, self.schema.target, (key,)))
        return df

    # scalars

    def _value(self, x: Call | Token) -> Value:
        if isinstance(x, Token):
            c = self._column(x)
            return Value(F.col(c.name), c.feature_type)
        if x in self.names:
            return Value(F.col(self.names[x]), self._storage(x))
        n = x.name
        if n in ("original", "column", "output"):
            return self._value(x.args[0])
        if n in LABELS:
            v = self._value(x.args[0])
            return Value(S.label(v.column, v.storage), v.storage)
        if n in SPLITS:
            v = self._value(x.args[0])
            codes = [S.separator(str(a)) for a in x.args[1:]]
            if len(codes) != SPLITS[n]:
                raise PlanError(f"{x}: {SPLITS[n]} separator codes are needed")
            return Value({"split": S.split, "split_key": S.split_key, "split_value": S.split_value}[n](v.column, *codes), "string", True)
        args = [self._value(a) for a in x.args]
        columns = [a.column for a in args]
        if n in ARITHMETIC:
            if len(args) < 2 or n in ("subtract", "divide") and len(args) != 2:
                raise PlanError(f"{x}: wrong number of arguments")
            return Value(ARITHMETIC[n](*(c.cast("double") if a.storage in ("float", "double") or n == "divide" else c for a, c in zip(args, columns))), "double" if n == "divide" or any(a.storage in ("float", "double") for a in args) else "bigint")
        if n in UNARY:
            return Value(UNARY[n](columns[0]), "double" if n == "log" else "int")
        if n == "timediff":
            return Value(S.timediff(*columns), "bigint")
        if n == "isin":
            values = columns[1] if args[1].is_array else F.array(columns[1].cast("string"))
            return Value(S.isin(columns[0], values), "int")
        if n == "combine":
            if len(args) not in (2, 3):
                raise PlanError(f"{x}: two or three arguments are needed")
            many = [a.is_array for a in args]
            return Value(S.combine(columns, many), "string", any(many))
        if n == "ifnull":
            return Value(F.coalesce(*columns), args[0].storage)
        if n == "isnull":
            return Value(columns[0].isNull(), "boolean")
        if n == "if":
            return Value(F.when(columns[0], columns[1]).otherwise(columns[2]), args[1].storage)
        if n == "continuous":
            return Value(S.continuous(columns[0]), "double")
        if n == "discrete":
            return Value(S.discrete(columns[0], args[0].is_array), "bigint", args[0].is_array)
        if n in CASTS:
            return Value(columns[0].try_cast(n), n)
        raise UnknownOperator(n)

    def _storage(self, c: Call) -> str:
        if c.name in ("multi_direct", "multi_last_value"):
            return self._column(c.args[1], False).feature_type
        agg = WINDOW_OPS.get(c.name) or MULTI_OPS[c.name]
        if agg in ("count", "unique_count"):
            return "bigint"
        if agg == "top3frequency":
            return "string"
        if agg in ("min", "max"):
            arg = c.args[-1] if c.name in WINDOW_OPS else c.args[1]
            return self._column(arg, False).feature_type if isinstance(arg, Token) else "double"
        return "double"


def compile_program(config: str | dict | Schema, program: str | list[Call], tables: dict[str, DataFrame], mode: str = "golden", strict: bool = False, names: list[str] | None = None, keep: list[str] | None = None, order: tuple[str, ...] = (), sliced: bool | str = False) -> DataFrame:
    """One DataFrame for a feature program: the main table's index and a column for each line. strict: drop what the text generators drop; sliced: as for Planner."""
    from .schema import load_schema

    schema = config if isinstance(config, Schema) else load_schema(config)
    lines = parse_program(program) if isinstance(program, str) else program
    if strict:
        lines = strict_filter(lines, schema)
    return Planner(schema, tables, mode, order, sliced).plan(lines, names, keep)


def split_stages(program: list[Call]) -> tuple[list[Call], list[Call]]:
    """(column stage, signature stage): the joined and windowed calls to be computed as columns, and the lines over them."""
    columns = list(dict.fromkeys(c for line in program for c in line.calls() if _scoped(c)))
    return columns, program

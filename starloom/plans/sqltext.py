"""Feature SQL text of a program: one SELECT for each scope, for reading and for engines that know last joins and union windows."""

from __future__ import annotations

from .dsl import Call, parse_program
from .frames import UNLIMITED, parse_frame
from .planner import MULTI_OPS, WINDOW_OPS, feature_name
from .schema import Schema

_PLACEHOLDER = {"string": "''", "double": "double(0)", "float": "float(0)", "int": "int(0)", "smallint": "int(0)", "bigint": "bigint(0)", "long": "bigint(0)", "timestamp": "timestamp('2019-07-18 09:20:20')", "date": "date('2019-07-18')", "boolean": "false"}
_CALLS = {"unique_count": "distinct_count({0}) over {1}", "top1_ratio": "top1_ratio({0}) over {1}", "top3frequency": "top_frequency({0}, 3) over {1}", "count": "count({0}) over {1}"}


def _window(keys: tuple[str, ...], time: str, text: str, union: str = "") -> str:
    f = parse_frame(text)
    if f.kind == "rows":
        span = f"rows between {f.high} preceding and {f.low} preceding"
    else:
        span = f"rows_range between {f.high // 1_000_000}s preceding and {f.low // 1_000_000}s preceding"
        span += f" maxsize {f.max_rows}" if f.max_rows < UNLIMITED else ""
    tail = " instance_not_in_window" if union else ""
    return f"({union}partition by {', '.join(f'`{k}`' for k in keys)} order by `{time}` {span}{tail})"


def to_sql(schema: Schema, program: str | list[Call]) -> str:
    """SELECT statements, separated by semicolons: main columns and windows, last joins, and one union window for each 1-M relation."""
    lines = parse_program(program) if isinstance(program, str) else program
    main, joins, unions, selects, windows = schema.target, {}, {}, [], {}
    for call in dict.fromkeys(c for line in lines for c in line.calls()):
        name = feature_name(call)
        if call.name == "original":
            selects.append(f"`{str(call.args[0]).partition('.')[2]}` as `{name}`")
        elif call.name in WINDOW_OPS:
            time, key, value = (str(call.args[i]).partition(".")[2] for i in (0, 1, 3))
            alias = windows.setdefault(_window((key,), time, str(call.args[2])), f"w{len(windows)}")
            selects.append(_CALLS.get(WINDOW_OPS[call.name], WINDOW_OPS[call.name] + "({0}) over {1}").format(f"`{value}`", alias) + f" as `{name}`")
        elif call.name in ("multi_direct", "multi_last_value"):
            table, _, column = str(call.args[1]).partition(".")
            r = schema.relation(table, "1-1") if call.name == "multi_direct" else schema.relation(table, "SLICE", "1-M")
            on = " and ".join(f"`{main}`.`{a}` = `{table}`.`{b}`" for a, b in zip(r.from_keys, r.to_keys))
            if call.name == "multi_last_value":
                on = f"order by `{table}`.`{r.to_time}` on {on} and `{table}`.`{r.to_time}` < `{main}`.`{r.from_time}`"
            else:
                on = f"on {on}"
            joins.setdefault(f"last join `{table}` {on}", []).append(f"`{table}`.`{column}` as `{name}`")
        elif call.name in MULTI_OPS:
            arg = call.args[1].args[0] if isinstance(call.args[1], Call) else call.args[1]
            table, _, column = str(arg).partition(".")
            r = schema.relation(table, "1-M", "SLICE")
            swap = {b: f"`{a}` as `{b}`" for a, b in zip((*r.from_keys, r.from_time), (*r.to_keys, r.to_time))}
            aligned = ", ".join(swap.get(c.name) or f"{_PLACEHOLDER[c.feature_type]} as `{c.name}`" for c in schema.tables[table])
            window = _window(r.to_keys, r.to_time, str(call.args[2]), f"union `{table}` ")
            text = _CALLS.get(MULTI_OPS[call.name], MULTI_OPS[call.name] + "({0}) over {1}").format(f"`{column}`", "w")
            unions.setdefault((table, aligned, window), []).append(f"{text} as `{name}`")
    out = []
    if selects:
        out.append(f"select {', '.join(selects)} from `{main}`" + ("" if not windows else " window " + ", ".join(f"{a} as {w}" for w, a in windows.items())))
    out += [f"select {', '.join(v)} from `{main}` {j}" for j, v in joins.items()]
    out += [f"select {', '.join(v)} from (select {aligned} from `{main}`) window w as {w}" for (_, aligned, w), v in unions.items()]
    return ";\n".join(out)

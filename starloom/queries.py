"""Queries over the driver's tables, one or more for each operator, with independently written DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import joins, prep
from .plans.planner import compile_program
from .plans.schema import load_schema
from .sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(columns: dict[str, str], table: str) -> dict:
    meanings = {"string": "SingleString", "timestamp": "Timestamp"}
    return {"features": [{"id": f"{table}.{c}", "feature_type": t, "data_type": meanings.get(t, "ContinueNum")} for c, t in columns.items()]}


EVENTS = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double"}
ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}
LINES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}
CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _relation(kind: str, main: str, keys: list[str], side: str, side_keys: list[str], time: str = "", side_time: str = "", order: tuple[str, ...] = ()) -> dict:
    return {"type": kind, "from_entity": main, "from_entity_keys": keys, "to_entity": side, "to_entity_keys": side_keys, "from_entity_time_col": time, "to_entity_time_col": side_time, "order_by": list(order)}


EVENT_STAR = {"target_entity": "events", "target_entity_index": "event_id", "entity_detail": {"events": _entity(EVENTS, "events")}}
SHOP = {
    "target_entity": "purchases", "target_entity_index": "event_id", "target_pivot_timestamp": "ts", "target_label": "value",
    "entity_detail": {"purchases": _entity(EVENTS, "purchases"), "views": _entity({**EVENTS, "tags": "string"}, "views")},
    "relations": [_relation(k, "purchases", ["user_id"], "views", ["user_id"], "ts", "ts", ("event_id",)) for k in ("SLICE", "1-M")],
}
TRADE = {
    "target_entity": "orders", "target_entity_index": "o_orderkey", "target_pivot_timestamp": "o_orderdate",
    "entity_detail": {"orders": _entity({**ORDERS, "kv": "string", "words": "string"}, "orders"), "customer": _entity(CUSTOMER, "customer"), "lineitem": _entity(LINES, "lineitem")},
    "relations": [
        _relation("1-1", "orders", ["o_custkey"], "customer", ["c_custkey"]),
        _relation("1-1", "orders", ["o_orderkey"], "lineitem", ["l_orderkey"], "", "l_shipdate", ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")),
        _relation("SLICE", "orders", ["o_orderkey"], "lineitem", ["l_orderkey"], "o_orderdate", "l_shipdate", ("l_linenumber", "l_partkey", "l_suppkey")),
        _relation("1-M", "orders", ["o_orderkey"], "lineitem", ["l_orderkey"], "o_orderdate", "l_shipdate", ("l_linenumber", "l_partkey", "l_suppkey")),
    ],
}
LINE_STAR = {
    "target_entity": "lineitem", "target_entity_index": "l_orderkey",
    "entity_detail": {"lineitem": _entity(LINES, "lineitem"), "part": _entity({"p_partkey": "bigint", "p_brand": "string", "p_size": "int", "p_retailprice": "double"}, "part"), "supplier": _entity({"s_suppkey": "bigint", "s_acctbal": "double"}, "supplier"), "keyed": _entity({"k_order": "bigint", "k_line": "int", "k_value": "double"}, "keyed")},
    "relations": [_relation("1-1", "lineitem", ["l_partkey"], "part", ["p_partkey"]), _relation("1-1", "lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]), _relation("1-1", "lineitem", ["l_orderkey", "l_linenumber"], "keyed", ["k_order", "k_line"])],
}


def event_program(spark: SparkSession, sf_dir: str, program: str, names: list[str], mode: str = "golden") -> DataFrame:
    return compile_program(EVENT_STAR, program, {"events": read(spark, sf_dir, "events")}, mode=mode, names=names, order=("event_id",))


def shop_program(spark: SparkSession, sf_dir: str, program: str, names: list[str], mode: str = "golden") -> DataFrame:
    e = read(spark, sf_dir, "events")
    tags = F.concat(F.lit("a:"), (F.col("event_id") % 3).cast("string"), F.lit(",b:"), (F.col("event_id") % 5).cast("string"))
    tables = {"purchases": e.where("event_type = 'purchase'"), "views": e.where("event_type = 'view'").withColumn("tags", tags)}
    return compile_program(SHOP, program, tables, mode=mode, names=names, order=("event_id",))


def trade_program(spark: SparkSession, sf_dir: str, program: str, names: list[str], mode: str = "golden") -> DataFrame:
    kv = F.concat(F.lit("p:"), F.col("o_orderpriority"), F.lit("|s:"), F.col("o_orderstatus"), F.lit("|x"))
    orders = read(spark, sf_dir, "orders").withColumn("kv", kv).withColumn("words", F.translate("o_orderpriority", "-", " "))
    return compile_program(TRADE, program, {"orders": orders, "customer": read(spark, sf_dir, "customer"), "lineitem": read(spark, sf_dir, "lineitem")}, mode=mode, names=names, order=("o_orderkey",))


# main-table windows -----------------------------------------------------------------------------------------------------

FRAMES = {"r10": "10:0", "d1": "1d:100:0s", "d7": "7d:20:0s", "lagged": "7d:100:1d", "open": "7d:2147483647:0s"}
_PAIR = {
    "r10": "b.rn BETWEEN a.rn - {rows} AND a.rn",
    "d1": "b.rn BETWEEN a.rn - {c100} + 1 AND a.rn AND b.ts {ge} a.ts - INTERVAL 1 DAY",
    "d7": "b.rn BETWEEN a.rn - {c20} + 1 AND a.rn AND b.ts {ge} a.ts - INTERVAL 7 DAY",
    "lagged": "b.ts <= a.ts - INTERVAL 1 DAY AND b.ts {ge} a.ts - INTERVAL 7 DAY",
    "open": "b.ts <= a.ts AND b.ts {ge} a.ts - INTERVAL 7 DAY",
}


def window_sql(agg: str, value: str, mode: str = "golden") -> str:
    """One CTE of (row, window row) pairs for each frame, aggregated plainly."""
    words = {"rows": "10", "c100": "100", "c20": "20", "ge": ">="} if mode == "golden" else {"rows": "9", "c100": "99", "c20": "19", "ge": ">"}
    plain = {
        "sum": "round(sum(v), 4)" if mode == "golden" else "round(coalesce(sum(v), 0), 4)", "avg": "round(avg(v), 6)", "min": "min(v)", "max": "max(v)", "unique_count": "count(DISTINCT v)",
        "count": "CASE WHEN any_value(own) IS NOT NULL THEN count(*) FILTER (WHERE v = own) END", "ratio": "CASE WHEN any_value(own) IS NOT NULL AND count(v) > 0 THEN round(count(*) FILTER (WHERE v = own)::DOUBLE / count(v), 6) END",
    }
    ctes, joins_ = [f"e AS (SELECT *, {value} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"], []
    for name, condition in _PAIR.items():
        pairs = f"SELECT a.event_id, a.v AS own, b.v AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS k FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND {condition.format(**words)}"
        if name == "lagged":
            pairs = f"SELECT * FROM ({pairs}) WHERE k <= {words['c100']}"
        if agg == "top1_ratio":
            ctes.append(f"{name} AS (SELECT event_id, round(max(c)::DOUBLE / sum(c), 6) AS {name} FROM (SELECT event_id, v, count(v) AS c FROM ({pairs}) GROUP BY ALL) GROUP BY event_id)")
        else:
            ctes.append(f"{name} AS (SELECT event_id, {plain[agg]} AS {name} FROM ({pairs}) GROUP BY event_id)")
        joins_.append(f"JOIN {name} USING (event_id)")
    select = ", ".join(f"CASE WHEN isnan({n}) THEN NULL ELSE {n} END AS {n}" if agg == "top1_ratio" else n for n in FRAMES)
    return f"WITH {', '.join(ctes)} SELECT event_id, {select} FROM e {' '.join(joins_)}"


def _rounded(df: DataFrame, digits: int, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c) for c, t in df.dtypes))


def _window_query(agg: str, mode: str) -> None:
    value = "value" if agg in ("sum", "avg", "min", "max") else "event_type"

    def run(spark, sf_dir):
        lines = "\n".join(f"window_{agg}(events.ts,events.user_id,{w},events.{value})" for w in FRAMES.values())
        return _rounded(event_program(spark, sf_dir, lines, list(FRAMES), mode), 4 if agg == "sum" else 6)

    query(f"window_{agg}" + ("_runtime" if mode == "runtime" else ""), window_sql(agg, value, mode))(run)


for _agg in ("sum", "avg", "min", "max", "count", "unique_count", "top1_ratio", "ratio"):
    for _mode in ("golden", "runtime"):
        _window_query(_agg, _mode)


@query(
    "window_orders",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, round(avg(o_totalprice) OVER w, 4) AS mean, min(o_totalprice) OVER w AS least, max(o_totalprice) OVER w AS most
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def window_orders(spark, sf_dir):
    ops = [f"window_{a}(orders.o_orderdate,orders.o_custkey,5:0,orders.o_totalprice)" for a in ("sum", "avg", "min", "max")]
    df = trade_program(spark, sf_dir, "\n".join(ops), ["total", "mean", "least", "most"])
    return df.select("o_orderkey", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "least", "most")


# union windows ----------------------------------------------------------------------------------------------------------

MULTI_FRAMES = {"d1": "1d:2147483647:0s", "d7": "7d:5:0s", "r3": "3:0", "lagged": "7d:2147483647:1d"}


def multi_sql(agg: str, value: str, text: str, default: str, mode: str, pieces: str = "") -> str:
    golden = mode == "golden"
    below = "b.ts < a.ts" if golden else "b.ts <= a.ts"
    ge = ">=" if golden else ">"
    conditions = {
        "d1": (f"{below} AND b.ts {ge} a.ts - INTERVAL 1 DAY", None), "d7": (f"{below} AND b.ts {ge} a.ts - INTERVAL 7 DAY", 5 if golden else 4), "r3": (below, 3), "lagged": (f"b.ts <= a.ts - INTERVAL 1 DAY AND b.ts {ge} a.ts - INTERVAL 7 DAY", None),
    }
    plain = {
        "sum": "round(coalesce(sum(v), 0), 4)", "avg": "round(coalesce(sum(v), 0) / (count(v) + 1), 6)" if golden else "round(avg(v), 6)", "min": f"least(min(v), {default})" if golden else "min(v)", "max": f"greatest(max(v), {default})" if golden else "max(v)",
        "std": "round(stddev_samp(v), 6)", "count": "CASE WHEN count(v) > 0 THEN count(v) + 1 END" if golden else "count(v)", "unique_count": f"count(DISTINCT v) + CASE WHEN bool_or(v = {default}) THEN 0 ELSE 1 END" if golden else "count(DISTINCT v)",
    }
    sides = f"(SELECT *, {value} AS v, 'a:' || (event_id % 3) || ',b:' || (event_id % 5) AS tags FROM events WHERE event_type = 'view')"
    ctes, joins_ = ["m AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')", f"s AS (SELECT * FROM {sides})"], []
    for name, (condition, cap) in conditions.items():
        pairs = f"SELECT a.event_id, b.v, b.event_id AS bid, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS k FROM m a LEFT JOIN s b ON a.user_id = b.user_id AND {condition}"
        pairs = f"SELECT * FROM ({pairs})" + (f" WHERE k <= {cap}" if cap else "")
        if pieces:
            pairs = f"SELECT event_id, {pieces} AS v FROM ({pairs})"
        if agg == "top3frequency":
            values = f"SELECT event_id, v FROM ({pairs}) WHERE v IS NOT NULL" + (f" UNION ALL SELECT event_id, {default} FROM m" if golden else "")
            ranked = f"SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, v) AS k FROM ({values}) GROUP BY event_id, v"
            top = f"SELECT event_id, string_agg({text}, ',' ORDER BY k) || repeat(',NULL', 3 - count(*)::INT) AS t FROM ({ranked}) WHERE k <= 3 GROUP BY event_id"
            ctes.append(f"{name} AS (SELECT m.event_id, t AS {name} FROM m LEFT JOIN ({top}) USING (event_id))")
        else:
            ctes.append(f"{name} AS (SELECT event_id, {plain[agg]} AS {name} FROM ({pairs}) GROUP BY event_id)")
        joins_.append(f"JOIN {name} USING (event_id)")
    return f"WITH {', '.join(ctes)} SELECT event_id, {', '.join(MULTI_FRAMES)} FROM m {' '.join(joins_)}"


def _multi_query(agg: str, mode: str) -> None:
    def run(spark, sf_dir):
        lines = "\n".join(f"multi_{agg}(purchases,views.value,{w})" for w in MULTI_FRAMES.values())
        return _rounded(shop_program(spark, sf_dir, lines, list(MULTI_FRAMES), mode), 4 if agg == "sum" else 6)

    query(f"multi_{agg}" + ("_runtime" if mode == "runtime" else ""), multi_sql(agg, "value", "printf('%.6f', v)", "0.0::DOUBLE", mode))(run)


for _agg in ("sum", "avg", "min", "max", "std", "count", "unique_count", "top3frequency"):
    for _mode in ("golden", "runtime"):
        _multi_query(_agg, _mode)


def _pieces_query(op: str, agg: str, pieces: str, text: str, default: str) -> None:
    def run(spark, sf_dir):
        arg = "split(views.tags,44)" if op == "split" else f"{op}(views.tags,44,58)"
        return _rounded(shop_program(spark, sf_dir, "\n".join(f"multi_{agg}(purchases,{arg},{w})" for w in MULTI_FRAMES.values()), list(MULTI_FRAMES)), 6)

    listed = "['a:' || (bid % 3), 'b:' || (bid % 5)]"
    source = {"split": f"unnest(CASE WHEN bid IS NULL THEN [NULL] ELSE {listed} END)", "split_key": "unnest(CASE WHEN bid IS NULL THEN [NULL] ELSE ['a', 'b'] END)", "split_value": "unnest(CASE WHEN bid IS NULL THEN [NULL] ELSE [(bid % 3)::DOUBLE, (bid % 5)::DOUBLE] END)"}[op]
    query(f"multi_{agg}_over_{op}", multi_sql(agg, "value", text, default, "golden", source))(run)


_pieces_query("split", "unique_count", "", "v", "''")
_pieces_query("split_key", "top3frequency", "", "v", "''")
_pieces_query("split_value", "sum", "", "printf('%.6f', v)", "0.0::DOUBLE")


_HOT = ["window_sum(events.ts,events.event_type,1d:2147483647:0s,events.value)", "window_max(events.ts,events.event_type,12h:50:0s,events.value)", "window_sum(events.ts,events.event_type,1d:2147483647:6h,events.value)"]


@query(
    "window_sliced",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
       SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS day,
              (SELECT max(b.value) FROM e b WHERE b.event_type = a.event_type AND b.rn BETWEEN a.rn - 49 AND a.rn AND b.ts >= a.ts - INTERVAL 12 HOUR) AS most,
              round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 6 HOUR PRECEDING), 4) AS lagged FROM e a""",
)
def window_sliced(spark, sf_dir):
    """Few keys with many rows each: keys are dealt by slices of time as well."""
    df = compile_program(EVENT_STAR, "\n".join(_HOT), {"events": read(spark, sf_dir, "events")}, names=["day", "most", "lagged"], order=("event_id",), sliced=True)
    return _rounded(df, 4, ("most",))


# joins ------------------------------------------------------------------------------------------------------------------


@query(
    "multi_direct",
    """SELECT o_orderkey, c_acctbal AS balance, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def multi_direct(spark, sf_dir):
    return trade_program(spark, sf_dir, "multi_direct(orders,customer.c_acctbal)\nmulti_direct(orders,customer.c_mktsegment)", ["balance", "segment"])


@query(
    "multi_direct_last_row",
    """SELECT o_orderkey, l_quantity AS quantity, l_returnflag AS flag FROM orders LEFT JOIN
       (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) l ON o_orderkey = l_orderkey AND k = 1""",
)
def multi_direct_last_row(spark, sf_dir):
    return trade_program(spark, sf_dir, "multi_direct(orders,lineitem.l_quantity)\nmulti_direct(orders,lineitem.l_returnflag)", ["quantity", "flag"])


@query(
    "direct_two_sides",
    """SELECT l_orderkey, l_linenumber, p_brand AS brand, p_retailprice AS price, s_acctbal AS balance, k.v AS keyed
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
       LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2) k USING (l_orderkey, l_linenumber)""",
)
def direct_two_sides(spark, sf_dir):
    """Two single keys and a composite one."""
    lines = read(spark, sf_dir, "lineitem")
    tables = {"lineitem": lines, "part": read(spark, sf_dir, "part"), "supplier": read(spark, sf_dir, "supplier"), "keyed": lines.select(F.col("l_orderkey").alias("k_order"), F.col("l_linenumber").alias("k_line"), F.col("l_quantity").alias("k_value"))}
    ops = ["multi_direct(lineitem,part.p_brand)", "multi_direct(lineitem,part.p_retailprice)", "multi_direct(lineitem,supplier.s_acctbal)", "multi_direct(lineitem,keyed.k_value)"]
    return compile_program(LINE_STAR, "\n".join(ops), tables, names=["brand", "price", "balance", "keyed"], keep=["l_orderkey", "l_linenumber"])


def _last_sql(below: str, age: str = "TRUE") -> str:
    return f"""WITH p AS (SELECT a.event_id, b.value, b.event_id AS bid, {age} AS fresh, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS k
       FROM events a LEFT JOIN events b ON b.event_type = 'view' AND a.user_id = b.user_id AND b.ts {below} a.ts WHERE a.event_type = 'purchase')
       SELECT event_id, CASE WHEN fresh THEN value END AS last_value, CASE WHEN fresh THEN bid END AS last_id FROM p WHERE k = 1"""


for _name, _window, _mode, _below, _age in (
    ("multi_last_value", "2147483645:0", "golden", "<", "TRUE"),
    ("multi_last_value_bounded", "1d:1d", "golden", "<", "b.ts > a.ts - INTERVAL 1 DAY"),
    ("multi_last_value_runtime", "2147483645:0", "runtime", "<=", "TRUE"),
):

    def _last(spark, sf_dir, window=_window, mode=_mode):
        window = "1d:0s" if window == "1d:1d" else window
        return shop_program(spark, sf_dir, f"multi_last_value(purchases,views.value,{window})\nmulti_last_value(purchases,views.event_id,{window})", ["last_value", "last_id"], mode)

    query(_name, _last_sql(_below, _age))(_last)


@query(
    "last_join_orders",
    """SELECT o.o_orderkey, l.l_quantity AS quantity FROM orders o LEFT JOIN
       (SELECT o_orderkey, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate) l
       ON o.o_orderkey = l.o_orderkey AND l.k = 1""",
)
def last_join_orders(spark, sf_dir):
    return trade_program(spark, sf_dir, "multi_last_value(orders,lineitem.l_quantity,2147483645:0)", ["quantity"])


@query(
    "union_orders",
    """SELECT o_orderkey, coalesce(round(sum(l_extendedprice), 2), 0) AS total, CASE WHEN count(l_orderkey) > 0 THEN count(l_orderkey) + 1 END AS n
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate AND l_shipdate >= o_orderdate - INTERVAL 32 DAY GROUP BY o_orderkey""",
)
def union_orders(spark, sf_dir):
    df = trade_program(spark, sf_dir, "multi_sum(orders,lineitem.l_extendedprice,32d:2147483647:0s)\nmulti_count(orders,lineitem.l_orderkey,32d:2147483647:0s)", ["total", "n"])
    return df.withColumn("total", F.round("total", 2))


# scalars, splits, labels ------------------------------------------------------------------------------------------------


def _line_scalar(name: str, program: list[tuple[str, str]], sql: str) -> None:
    def run(spark, sf_dir):
        df = compile_program(LINE_STAR, "\n".join(p for _, p in program), {"lineitem": read(spark, sf_dir, "lineitem")}, names=[n for n, _ in program], keep=["l_orderkey", "l_linenumber"])
        return _rounded(df, 6)

    query(name, f"SELECT l_orderkey, l_linenumber, {sql} FROM lineitem")(run)


_line_scalar("original", [("quantity", "original(lineitem.l_quantity)"), ("flag", "original(lineitem.l_returnflag)")], "l_quantity AS quantity, l_returnflag AS flag")
_line_scalar("add", [("two", "add(lineitem.l_quantity,lineitem.l_tax)"), ("three", "add(lineitem.l_quantity,lineitem.l_tax,lineitem.l_discount)")], "round(l_quantity + l_tax, 6) AS two, round(l_quantity + l_tax + l_discount, 6) AS three")
_line_scalar("multiply", [("two", "multiply(lineitem.l_quantity,lineitem.l_tax)"), ("three", "multiply(lineitem.l_quantity,lineitem.l_tax,lineitem.l_discount)")], "round(l_quantity * l_tax, 6) AS two, round(l_quantity * l_tax * l_discount, 6) AS three")
_line_scalar("subtract", [("x", "subtract(lineitem.l_quantity,lineitem.l_tax)")], "round(l_quantity - l_tax, 6) AS x")
_line_scalar("divide", [("x", "divide(lineitem.l_quantity,lineitem.l_tax)")], "CASE WHEN l_tax <> 0 THEN round(l_quantity / l_tax, 6) END AS x")
_line_scalar("log", [("x", "log(lineitem.l_discount)")], "CASE WHEN l_discount > 0 THEN round(ln(l_discount), 6) END AS x")
_line_scalar("dayofweek", [("x", "dayofweek(lineitem.l_shipdate)")], "(dayofweek(l_shipdate) + 1)::INT AS x")
_line_scalar("isweekday", [("x", "isweekday(lineitem.l_shipdate)")], "CASE WHEN dayofweek(l_shipdate) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS x")
_line_scalar("hourofday", [("x", "hourofday(lineitem.l_shipdate)")], "hour(l_shipdate)::INT AS x")
_line_scalar("combine", [("two", "combine(lineitem.l_returnflag,lineitem.l_linestatus)"), ("three", "combine(lineitem.l_returnflag,lineitem.l_linestatus,lineitem.l_linenumber)")], "l_returnflag || ',' || l_linestatus AS two, l_returnflag || ',' || l_linestatus || ',' || l_linenumber AS three")
_line_scalar("casts", [("i", "int(lineitem.l_quantity)"), ("s", "string(lineitem.l_linenumber)"), ("d", "double(lineitem.l_linenumber)"), ("b", "bigint(lineitem.l_linenumber)")], "trunc(l_quantity)::INT AS i, l_linenumber::VARCHAR AS s, l_linenumber::DOUBLE AS d, l_linenumber::BIGINT AS b")
_line_scalar("continuous", [("x", "continuous(lineitem.l_linenumber)")], "l_linenumber::DOUBLE AS x")
_line_scalar("regression_label", [("x", "regression_label(lineitem.l_tax)")], "coalesce(l_tax, 0) AS x")
_line_scalar("if_null", [("x", "ifnull(divide(lineitem.l_quantity,lineitem.l_tax),lineitem.l_quantity)"), ("n", "isnull(log(lineitem.l_discount))"), ("c", "if(isnull(log(lineitem.l_discount)),lineitem.l_tax,lineitem.l_discount)")], "round(CASE WHEN l_tax <> 0 THEN l_quantity / l_tax ELSE l_quantity END, 6) AS x, NOT (l_discount > 0) AS n, round(CASE WHEN l_discount > 0 THEN l_discount ELSE l_tax END, 6) AS c")


def _trade_scalar(name: str, program: list[tuple[str, str]], select: str, joins_sql: str = "", arrays: tuple[str, ...] = ()) -> None:
    def run(spark, sf_dir):
        df = trade_program(spark, sf_dir, "\n".join(p for _, p in program), [n for n, _ in program])
        return df.select(*(F.array_join(c, ";", "NULL").alias(c) if c in arrays else F.col(c) for c in df.columns))

    query(name, f"SELECT o_orderkey, {select} FROM orders {joins_sql}")(run)


_JOINED = "LEFT JOIN customer ON o_custkey = c_custkey"
_LAST_LINE = "LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) l ON o_orderkey = l_orderkey AND k = 1"
_trade_scalar("split", [("x", "split(orders.words,32)")], "replace(replace(o_orderpriority, '-', ' '), ' ', ';') AS x", arrays=("x",))
_trade_scalar("split_key", [("x", "split_key(orders.kv,124,58)")], "'p;s;x' AS x", arrays=("x",))
_trade_scalar("split_value", [("x", "split_value(orders.kv,124,58)")], "o_orderpriority || ';' || o_orderstatus || ';NULL' AS x", arrays=("x",))
_trade_scalar("isin", [("x", "isin(orders.o_orderstatus,split_value(orders.kv,124,58))"), ("y", "isin(orders.o_orderstatus,orders.o_orderpriority)")], "1 AS x, CASE WHEN o_orderstatus = o_orderpriority THEN 1 ELSE 0 END AS y")
_trade_scalar("combine_lists", [("x", "combine(split_key(orders.kv,124,58),orders.o_orderstatus)")], "'p,' || o_orderstatus || ';s,' || o_orderstatus || ';x,' || o_orderstatus AS x", arrays=("x",))
_trade_scalar("timediff", [("x", "timediff(orders.o_orderdate,multi_direct(orders,lineitem.l_shipdate))")], "epoch(o_orderdate)::BIGINT - epoch(l_shipdate)::BIGINT AS x", _LAST_LINE)
_trade_scalar("binary_label", [("x", "binary_label(multi_direct(orders,customer.c_mktsegment))"), ("y", "binary_label(orders.o_custkey)")], "coalesce(c_mktsegment, '0') AS x, coalesce(o_custkey, 0) AS y", _JOINED)
_trade_scalar("nested", [("x", "dayofweek(multi_direct(orders,lineitem.l_shipdate))"), ("y", "combine(orders.o_orderstatus,multi_direct(orders,customer.c_mktsegment))")], "(dayofweek(l_shipdate) + 1)::INT AS x, concat_ws(',', o_orderstatus, c_mktsegment) AS y", f"{_JOINED} {_LAST_LINE}")


COMPOSITE = [
    ("price", "original(orders.o_totalprice)"), ("segment", "multi_direct(orders,customer.c_mktsegment)"), ("last_quantity", "multi_last_value(orders,lineitem.l_quantity,2147483645:0)"),
    ("spent", "multi_sum(orders,lineitem.l_extendedprice,32d:2147483647:0s)"), ("n_lines", "multi_count(orders,lineitem.l_orderkey,32d:2147483647:0s)"), ("recent", "window_sum(orders.o_orderdate,orders.o_custkey,5:0,orders.o_totalprice)"),
    ("share", "divide(orders.o_totalprice,window_sum(orders.o_orderdate,orders.o_custkey,5:0,orders.o_totalprice))"), ("weekday", "isweekday(orders.o_orderdate)"), ("cross", "combine(orders.o_orderstatus,multi_direct(orders,customer.c_mktsegment))"), ("label", "binary_label(multi_direct(orders,customer.c_acctbal))"),
]


@query(
    "composite",
    """WITH r AS (SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent FROM orders),
       s AS (SELECT o_orderkey, sum(l_extendedprice) AS spent, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate AND l_shipdate >= o_orderdate - INTERVAL 32 DAY GROUP BY o_orderkey),
       q AS (SELECT o_orderkey, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate)
       SELECT o_orderkey, o_totalprice AS price, c_mktsegment AS segment, l_quantity AS last_quantity, coalesce(round(spent, 2), 0) AS spent, CASE WHEN n > 0 THEN n + 1 END AS n_lines, round(recent, 2) AS recent,
              round(o_totalprice / recent, 6) AS share, CASE WHEN dayofweek(o_orderdate) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS weekday, concat_ws(',', o_orderstatus, c_mktsegment) AS "cross", coalesce(c_acctbal, 0) AS label
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN r USING (o_orderkey) LEFT JOIN s USING (o_orderkey) LEFT JOIN q ON orders.o_orderkey = q.o_orderkey AND q.k = 1""",
)
def composite(spark, sf_dir):
    """The flagship: every scope in one plan."""
    df = trade_program(spark, sf_dir, "\n".join(p for _, p in COMPOSITE), [n for n, _ in COMPOSITE])
    digits = {"spent": 2, "recent": 2, "share": 6}
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


@query(
    "list_functions",
    """WITH l AS (SELECT l_orderkey, list(l_linestatus || l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS v, list(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
       c AS (SELECT l_orderkey, l_linestatus || l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL),
       r AS (SELECT l_orderkey, string_agg(k, ';' ORDER BY n DESC, k) FILTER (WHERE i <= 2) AS common, max(n) AS most FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, k) AS i FROM c) GROUP BY 1)
       SELECT l_orderkey, common, most, v[1] AS earliest, v[-1] AS latest, list_aggregate(q, 'max') AS largest, len(list_filter(q, lambda x: x > 25)) AS many, len(v) AS n FROM l JOIN r USING (l_orderkey)""",
)
def list_functions(spark, sf_dir):
    """Grouping, ranking and picking in a list of each order's lines."""
    from .functions import lists as L

    rows = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_linestatus", "l_returnflag").alias("v"), "l_quantity")))
    df = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", F.col("rows.v").alias("v"), F.col("rows.l_quantity").alias("q"))
    counts = L.group_by(F.col("v"))
    return df.select(
        "l_orderkey", F.array_join(L.take(L.sort_by_value(counts), 0, 2), ";").alias("common"), F.array_max(L.get_values(counts)).cast("long").alias("most"), L.first(F.col("v")).alias("earliest"), L.at(F.col("v"), 0).alias("latest"),
        L.first(L.top(F.col("q"))).alias("largest"), L.count_where(F.col("q"), lambda x: x > 25).alias("many"), L.count_of_window(F.col("v")).alias("n"),
    )


@query("split_by_key", "SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, 'p;s;x' AS keys FROM orders")
def split_by_key(spark, sf_dir):
    from .functions import lists as L

    kv = F.concat(F.lit("p:"), F.col("o_orderpriority"), F.lit("|s:"), F.col("o_orderstatus"), F.lit("|x|p:again"))
    m = L.split_by_key(kv, "|", ":")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(m, "p").alias("p"), F.element_at(m, "s").alias("s"), F.array_join(L.get_keys(m), ";").alias("keys"))


# preparation and statistics ---------------------------------------------------------------------------------------------


@query("semi_join_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_filter(spark, sf_dir):
    main = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return joins.semi_join_filter(read(spark, sf_dir, "lineitem"), main, [("o_orderkey", "l_orderkey")]).select("l_orderkey", "l_linenumber")


@query("existence_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) AND l_suppkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def existence_filter(spark, sf_dir):
    main = read(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return joins.existence_filter(read(spark, sf_dir, "lineitem"), main, [("o_orderkey", "l_orderkey"), ("o_custkey", "l_suppkey")]).select("l_orderkey", "l_linenumber")


_CUT = "(SELECT quantile_disc(o_orderdate, 0.8) AS cut, max(o_orderdate) AS top FROM orders)"


@query("validation_split", f"SELECT o_orderkey, CASE WHEN o_orderdate < cut OR o_orderdate = cut AND cut < top THEN 'train' ELSE 'valid' END AS side FROM orders, {_CUT}")
def validation_split(spark, sf_dir):
    train, valid = prep.validation_split(read(spark, sf_dir, "orders"), "o_orderdate", 0.2)
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(valid.select("o_orderkey", F.lit("valid").alias("side")))


@query("old_new_split", "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'old' ELSE 'new' END AS side FROM orders")
def old_new_split(spark, sf_dir):
    old, new = prep.old_new_split(read(spark, sf_dir, "orders"), "o_orderdate", 820454400_000_000, 1.0, "o_orderkey")
    return old.select("o_orderkey", F.lit("old").alias("side")).unionByName(new.select("o_orderkey", F.lit("new").alias("side")))


@query(
    "top_categories",
    """SELECT feature, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM
       (SELECT 'o_orderpriority' AS feature, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, count(*) FROM orders GROUP BY o_custkey)) WHERE rank <= 10""",
)
def top_categories(spark, sf_dir):
    return prep.top_categories(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"], 10)


@query("distinct_counts", "SELECT 'o_orderpriority' AS feature, count(DISTINCT o_orderpriority) AS n FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders")
def distinct_counts(spark, sf_dir):
    return prep.distinct_counts(read(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"])


@query("max_lengths", "SELECT 'words' AS feature, max(len(string_split(p_type, ' '))) AS n FROM part")
def max_lengths(spark, sf_dir):
    return prep.max_lengths(read(spark, sf_dir, "part").select(F.split("p_type", " ").alias("words")), ["words"])


@query("quantiles", "SELECT i::INT AS i, list_extract((SELECT quantile_disc(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM orders), i) AS cut FROM range(1, 10) t(i)")
def quantiles(spark, sf_dir):
    cuts = prep.quantiles(read(spark, sf_dir, "orders"), "o_totalprice", 10, 100_000)
    return spark.createDataFrame(list(enumerate(cuts, 1)), "i int, cut double")


@query("hot_keys", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 0.2 * (SELECT count(*) FROM orders)")
def hot_keys(spark, sf_dir):
    return prep.hot_keys(read(spark, sf_dir, "orders"), "o_orderpriority", 0.2)


@query("time_gaps", "SELECT min(gap) AS least_gap, min(us) AS first, max(us) AS last FROM (SELECT us, us - lag(us) OVER (ORDER BY us) AS gap FROM (SELECT DISTINCT epoch_us(ts) AS us FROM events))")
def time_gaps(spark, sf_dir):
    return prep.time_gaps(read(spark, sf_dir, "events"), "ts")


# sources ----------------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{sources.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _separated(kind: str, sep: str):
    def run(spark, sf_dir):
        path = _scratch(spark, kind)
        read(spark, sf_dir, "customer").write.option("sep", sep).csv(path)
        return sources.read_table(spark, path, kind, load_schema(TRADE), "customer")

    return run


query("source_csv", "SELECT * FROM customer")(_separated("csv", ","))
query("source_tsv", "SELECT * FROM customer")(_separated("tsv", "\t"))


@query("source_parquet", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def source_parquet(spark, sf_dir):
    return sources.read_table(spark, f"{sf_dir}/customer.parquet", "parquet", load_schema(TRADE), "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")


@query("sink_predictions", "SELECT c_custkey || chr(9) || c_mktsegment AS value FROM customer")
def sink_predictions(spark, sf_dir):
    path = _scratch(spark, "predictions")
    sources.write_predictions(read(spark, sf_dir, "customer"), path, ["c_custkey", "c_mktsegment"])
    return spark.read.text(path)


@query("table_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def table_filter(spark, sf_dir):
    path = _scratch(spark, "filter")
    sources.filter_tables(spark, f"{sf_dir}/orders.parquet", [{"input_path": f"{sf_dir}/lineitem.parquet", "output_path": path, "from_entity_keys": ["o_orderkey"], "to_entity_keys": ["l_orderkey"]}])
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber")


# machine learning -------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with a label that depends on value and user."""
    e = read(spark, sf_dir, "events")
    y = ((F.col("value") + F.pmod("user_id", F.lit(7)) * 3) > 25).cast("int")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.pmod("user_id", F.lit(7)).alias("segment"), y.alias("label"))


_LABELLED = "(SELECT *, user_id % 7 AS segment, ((value + (user_id % 7) * 3) > 25)::INT AS label FROM events)"


@query("ml_auc", f"""
WITH s AS (SELECT value AS z, sum(label) AS p, sum(1 - label) AS n FROM {_LABELLED} GROUP BY 1),
c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def ml_auc(spark, sf_dir):
    from .ml.metrics import auc

    return spark.createDataFrame([(round(auc(_labelled(spark, sf_dir), "value", "label"), 6),)], "auc double")


@query("ml_histogram", f"""SELECT feature, bin, round(sum(0.5 - label)::DOUBLE, 4) AS g, round((count(*) * 0.25)::DOUBLE, 4) AS h, count(*) AS n FROM
(SELECT 'value' AS feature, least(greatest(ceil(value / 10) - 1, 0), 50)::BIGINT AS bin, label FROM {_LABELLED} UNION ALL SELECT 'segment', segment, label FROM {_LABELLED}) GROUP BY 1, 2""")
def ml_histogram(spark, sf_dir):
    """The first level's sums of the tree trainer, over bins with the cuts 10, 20, ... of value."""
    from .ml.gbm import GBM, Node, TreeConfig

    cuts = {"value": [10.0 * k for k in range(1, 51)], "segment": [float(k) for k in range(6)]}
    model = GBM(TreeConfig("label", ["value", "segment"]), cuts, {})
    data = model.binned(_labelled(spark, sf_dir)).select("__b0", "__b1", (F.lit(0.5) - F.col("label")).alias("__g"), F.lit(0.25).alias("__h"))
    hist = model.histogram(data, [Node(0)], [0], [0, 1])[0]
    rows = [(name, b, round(float(g), 4), round(float(h), 4), int(n)) for f, name in enumerate(("value", "segment")) for b, (g, h, n) in enumerate(hist[f]) if n]
    return spark.createDataFrame(rows, "feature string, bin long, g double, h double, n long")


@query("ml_split_gain", f"""
WITH b AS (SELECT CASE WHEN event_id % 5 = 0 THEN -1 ELSE floor(value / 10)::BIGINT END AS bin, sum(0.5 - label)::DOUBLE AS g, (count(*) * 0.25)::DOUBLE AS h FROM {_LABELLED} GROUP BY 1),
m AS (SELECT coalesce(sum(g) FILTER (WHERE bin = -1), 0) AS mg, coalesce(sum(h) FILTER (WHERE bin = -1), 0) AS mh, sum(g) AS g, sum(h) AS h FROM b),
c AS (SELECT bin, sum(b.g) OVER (ORDER BY bin) AS gl, sum(b.h) OVER (ORDER BY bin) AS hl FROM b WHERE bin >= 0),
s AS (SELECT bin, false AS missing_right, gl + mg AS gl, hl + mh AS hl, g, h FROM c, m UNION ALL SELECT bin, true, gl, hl, g, h FROM c, m),
k AS (SELECT *, gl * gl / (hl + 0.000001) + (g - gl) * (g - gl) / (h - hl + 0.000001) - g * g / (h + 0.000001) AS gain FROM s WHERE hl > 0 AND hl < h)
SELECT bin, missing_right, round(gain, 4) AS gain, round(gl, 4) AS g_left, round(hl, 4) AS h_left FROM k ORDER BY k.gain DESC, missing_right, bin LIMIT 1""")
def ml_split_gain(spark, sf_dir):
    """The best split of value by the trainer's own split finder on the whole histogram, a fifth of the values missing."""
    from .ml.gbm import GBM, Node, TreeConfig

    d = _labelled(spark, sf_dir)
    most = int(d.agg(F.max("value")).first()[0] // 10) + 1
    model = GBM(TreeConfig("label", ["value"]), {"value": [float(k) for k in range(most)]}, {})
    bin_ = F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.floor(F.col("value") / 10)).cast("int")
    data = d.select(bin_.alias("__b0"), (F.lit(0.5) - F.col("label")).alias("__g"), F.lit(0.25).alias("__h"))
    gain, _, b, missing_right, left, _ = model.best_split(model.histogram(data, [Node(0)], [0], [0])[0], 1, [0])
    return spark.createDataFrame([(int(b), bool(missing_right), round(float(gain), 4), round(float(left[0]), 4), round(float(left[1]), 4))], "bin long, missing_right boolean, gain double, g_left double, h_left double")


def _boosted_sql(numeric: dict[str, int], categorical: list[str], trees: int, depth: int, rate: float = 0.3, penalty: float = 1e-6) -> str:
    """Boosted trees in plain SQL: each level sums (node, feature, bin), takes each node's best split and sends its rows on. numeric: bins of each."""
    names = [*numeric, *categorical]
    cuts = [f"c_{n} AS (SELECT DISTINCT unnest(quantile_disc({n}::DOUBLE, [{', '.join(f'{i}/{k}' for i in range(1, k))}])) AS cut FROM d)" for n, k in numeric.items()]
    bins = [f"(SELECT count(*) FROM c_{n} WHERE cut < d.{n}) AS b_{n}" for n in numeric] + [f"{n} AS b_{n}" for n in categorical]
    ctes = [f"d AS (SELECT * FROM {_LABELLED})", *cuts, f"r0 AS MATERIALIZED (SELECT event_id, label::DOUBLE AS y, ln(avg(label) OVER () / (1 - avg(label) OVER ())) AS z, {', '.join(bins)} FROM d)"]
    for t in range(trees):
        ctes.append(f"p{t}_0 AS MATERIALIZED (SELECT *, 0 AS node, 1 / (1 + exp(-z)) - y AS g, (1 / (1 + exp(-z))) * (1 - 1 / (1 + exp(-z))) AS h FROM r{t})")
        for level in range(depth):
            now, out = f"p{t}_{level}", f"p{t}_{level + 1}"
            long = " UNION ALL ".join(f"SELECT node, {i} AS f, {f'b_{n}::BIGINT' if n in numeric else 'NULL'} AS bin, {'NULL' if n in numeric else f'b_{n}'} AS name, g, h FROM {now}" for i, n in enumerate(names))
            ctes.append(f"s_{now} AS (SELECT node, f, bin, name, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY ALL)")
            ctes.append(f"t_{now} AS (SELECT node, sum(g) AS tg, sum(h) AS th, count(*) AS tn FROM {now} GROUP BY node)")
            left = lambda x: f"CASE WHEN bin IS NULL THEN t{x} - {x} ELSE sum({x}) OVER (PARTITION BY node, f ORDER BY bin) END AS l{x}"
            ctes.append(f"l_{now} AS (SELECT *, {left('g')}, {left('h')}, {left('n')} FROM s_{now} JOIN t_{now} USING (node))")
            ctes.append(f"k_{now} AS (SELECT *, lg * lg / (lh + {penalty}) + (tg - lg) * (tg - lg) / (th - lh + {penalty}) - tg * tg / (th + {penalty}) AS gain FROM l_{now} WHERE ln > 0 AND ln < tn)")
            ctes.append(f"w_{now} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) AS place FROM k_{now}) WHERE place = 1 AND gain > 0)")
            goes = " ".join(f"WHEN w.f = {i} THEN (a.b_{n} {'> w.bin' if n in numeric else '= w.name'})::INT" for i, n in enumerate(names))
            ctes.append(f"{out} AS MATERIALIZED (SELECT a.* EXCLUDE (node), CASE WHEN w.f IS NULL THEN a.node ELSE 2 * a.node + 1 + CASE {goes} END END AS node FROM {now} a LEFT JOIN w_{now} w ON a.node = w.node)")
        ctes.append(f"r{t + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node, g, h, z), z - {rate} * sum(g) OVER (PARTITION BY node) / (sum(h) OVER (PARTITION BY node) + {penalty}) AS z FROM p{t}_{depth} a)")
    return f"WITH {', '.join(ctes)} SELECT event_id, round(1 / (1 + exp(-z)), 6) AS prediction FROM r{trees}"


@query("ml_gbm", _boosted_sql({"value": 20}, ["segment", "event_type"], 3, 3))
def ml_gbm(spark, sf_dir):
    from .ml.gbm import GBM, TreeConfig

    d = _labelled(spark, sf_dir)
    model = GBM.fit(d, TreeConfig("label", ["value"], ["segment", "event_type"], trees=3, max_depth=3, max_bins=20), _scratch(spark, "gbm"))
    return GBM.loads(model.dumps()).predict(d).select("event_id", F.round("prediction", 6).alias("prediction"))


@query("ml_linear")
def ml_linear(spark, sf_dir):
    from .ml.linear import LinearConfig, LinearModel

    d = _labelled(spark, sf_dir)
    return LinearModel.fit(d, LinearConfig("label", ["value"], ["segment"], max_iter=5)).predict(d).select("event_id", F.round("prediction", 4).alias("prediction"))


def _slotwise_sql(steps: int = 4, buckets: int = 100) -> str:
    """One Newton step a query over the rows of each bin, then the rank statistic of the held-out rows on a grid of 10000."""
    cuts = f"c AS (SELECT DISTINCT unnest(quantile_disc(value, [{', '.join(f'{i}/{buckets}' for i in range(1, buckets))}])) AS cut FROM d WHERE old)"
    ctes = [
        f"t AS (SELECT quantile_disc(ts, 0.8) AS cut FROM events), d AS (SELECT l.*, ts <= t.cut AS old, CASE WHEN event_type = 'view' THEN 0.25 ELSE -0.5 END AS base FROM {_LABELLED} l, t)", cuts,
        """x AS (SELECT old, label, base, unnest(['value', 'segment', 'event_type']) AS feature, unnest([(SELECT count(*) FROM c WHERE c.cut < d.value)::VARCHAR, segment::VARCHAR, event_type]) AS bin FROM d)""",
        "w0 AS (SELECT DISTINCT feature, bin, 0.0::DOUBLE AS w FROM x WHERE old)",
    ]
    for k in range(steps):
        p = "1 / (1 + exp(-(base + w)))"
        ctes.append(f"w{k + 1} AS (SELECT feature, bin, w + greatest(least((sum(label - {p}) - w) / (sum(({p}) * (1 - {p})) + 1), 4), -4) AS w FROM x JOIN w{k} USING (feature, bin) WHERE old GROUP BY feature, bin, w)")
    ctes.append(f"h AS (SELECT feature, round(10000 / (1 + exp(-(base + coalesce(w, 0)))))::BIGINT AS s, sum(label) AS p, sum(1 - label) AS n FROM x LEFT JOIN w{steps} USING (feature, bin) WHERE NOT old GROUP BY 1, 2)")
    return f"WITH {', '.join(ctes)}, b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT feature, round(sum(p * (before + n / 2)) / (sum(p) * sum(n)), 6) AS score FROM b GROUP BY feature"


@query("ml_slotwise", _slotwise_sql())
def ml_slotwise(spark, sf_dir):
    from .ml.scorer import slotwise_scores

    base = F.when(F.col("event_type") == "view", 0.25).otherwise(-0.5)
    train, valid = prep.validation_split(_labelled(spark, sf_dir).withColumn("base", base), "ts", 0.2)
    return slotwise_scores(train, valid, ["value"], ["segment", "event_type"], "base", "label").select("feature", F.round("score", 6).alias("score"))


@query("ml_slotwise_regression", f"""
WITH t AS (SELECT quantile_disc(ts, 0.8) AS cut FROM events), d AS (SELECT l.*, ts <= t.cut AS old FROM {_LABELLED} l, t),
x AS (SELECT old, value AS y, unnest(['segment', 'event_type']) AS feature, unnest([segment::VARCHAR, event_type]) AS bin FROM d),
w AS (SELECT feature, bin, sum(y - 20) / (count(*) + 1) AS w FROM x WHERE old GROUP BY 1, 2)
SELECT feature, round(-avg((20 + coalesce(w, 0) - y) ** 2), 6) AS score FROM x LEFT JOIN w USING (feature, bin) WHERE NOT old GROUP BY 1""")
def ml_slotwise_regression(spark, sf_dir):
    from .ml.scorer import slotwise_scores

    train, valid = prep.validation_split(_labelled(spark, sf_dir).withColumn("base", F.lit(20.0)), "ts", 0.2)
    return slotwise_scores(train, valid, [], ["segment", "event_type"], "base", "value", "regression").select("feature", F.round("score", 6).alias("score"))


@query("ml_metrics", f"""
WITH p AS (SELECT label, least(greatest(value / 200, 0.01), 0.99) AS p FROM {_LABELLED}),
s AS (SELECT p AS z, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY 1),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS logloss, round(avg(p), 6) AS mean_prediction, round(avg(label), 6) AS positive_ratio, count(*) AS rows,
       (SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) FROM c) AS auc FROM p""")
def ml_metrics(spark, sf_dir):
    from .ml.metrics import binary_metrics

    d = _labelled(spark, sf_dir).withColumn("p", F.least(F.greatest(F.col("value") / 200, F.lit(0.01)), F.lit(0.99)))
    m = binary_metrics(d, "p", "label")
    row = tuple(round(m[k], 6) for k in ("logloss", "mean_prediction", "positive_ratio", "auc"))
    return spark.createDataFrame([(*row, m["rows"])], "logloss double, mean_prediction double, positive_ratio double, auc double, rows long")


@query("ml_regression_metrics", f"SELECT round(avg((segment * 5 - value) ** 2), 6) AS mse, round(avg(abs(segment * 5 - value)), 6) AS mae, round(avg(segment * 5)::DOUBLE, 6) AS mean_prediction, count(*) AS rows, round(sqrt(avg((segment * 5 - value) ** 2)), 6) AS rmse FROM {_LABELLED}")
def ml_regression_metrics(spark, sf_dir):
    from .ml.metrics import regression_metrics

    m = regression_metrics(_labelled(spark, sf_dir).withColumn("p", (F.col("segment") * 5).cast("double")), "p", "value")
    return spark.createDataFrame([(*(round(m[k], 6) for k in ("mse", "mae", "mean_prediction", "rmse")), m["rows"])], "mse double, mae double, mean_prediction double, rmse double, rows long")


@query("ml_regression")
def ml_regression(spark, sf_dir):
    from .ml.linear import LinearConfig, choose_link

    train, valid = prep.validation_split(_labelled(spark, sf_dir), "ts", 0.2)
    config = LinearConfig("value", [], ["segment", "event_type"], "regression", max_iter=5)
    return choose_link(train, valid, config).predict(valid).select("event_id", F.round("prediction", 3).alias("prediction"))


@query("ml_tune")
def ml_tune(spark, sf_dir):
    from .ml.linear import LinearConfig
    from .ml.tune import Range, random_search

    train, valid = prep.validation_split(_labelled(spark, sf_dir), "ts", 0.2)
    found = random_search(train, valid, LinearConfig("label", ["value"], ["segment"], max_iter=3, buckets=(10,)), {"lambda_2": Range(1e-4, 1.0, "log")}, 2, 2)
    return spark.createDataFrame([(i, x["params"]["lambda_2"], round(x["score"], 4)) for i, x in enumerate(found)], "place int, lambda_2 double, score double")


@query("ml_search")
def ml_search(spark, sf_dir):
    """A search over all events with their users' views as a side table: the selected operators with their scores, after one rebasing."""
    from .ml.search import FeatureSearch, SearchConfig

    d = _labelled(spark, sf_dir).withColumn("user", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("tags", F.concat_ws(",", "event_type", F.col("segment").cast("string")))
    views = d.where("event_type = 'view'").select("user", "ts", F.col("value").alias("seen"), F.col("segment").cast("string").alias("kind"))
    f = lambda t, n, s, k: {"id": f"{t}.{n}", "feature_type": s, "data_type": k}
    main = [f("m", "event_id", "bigint", "SplitID"), f("m", "ts", "timestamp", "Timestamp"), f("m", "user", "string", "SingleString"), f("m", "event_type", "string", "SingleString"), f("m", "tags", "string", "ArrayString(,)"), f("m", "value", "double", "ContinueNum"), f("m", "segment", "bigint", "ContinueNum"), f("m", "label", "int", "DiscreteLabel")]
    side = [f("v", "user", "string", "SingleString"), f("v", "ts", "timestamp", "Timestamp"), f("v", "seen", "double", "ContinueNum"), f("v", "kind", "string", "SingleString")]
    relation = {**_relation("1-M", "m", ["user"], "v", ["user"], "ts", "ts", ("seen", "kind")), "time_windows": ["7d,20:0s"]}
    schema = load_schema({"target_entity": "m", "target_entity_index": "event_id", "target_pivot_timestamp": "ts", "target_label": "label", "entity_detail": {"m": {"features": main}, "v": {"features": side}}, "relations": [relation]})
    found = FeatureSearch(schema, {"m": d, "v": views}, SearchConfig("label", windows=["7d,20:0s"], temporal_limit=12, combine_limit=24, rebase_limit=12, rebase_rounds=1, select=(1, 4))).run()
    return spark.createDataFrame([(i, c.op, round(c.score, 4)) for i, c in enumerate(found)], "place int, op string, score double")


@query("ml_predict", _boosted_sql({"value": 10, "segment": 10}, [], 2, 2))
def ml_predict(spark, sf_dir):
    """A saved tree model applied to a table, written as text and read again."""
    from .ml.gbm import GBM, TreeConfig
    from .ml.predict import batch_predict

    d, path = _labelled(spark, sf_dir), _scratch(spark, "model")
    GBM.fit(d, TreeConfig("label", ["value", "segment"], trees=2, max_depth=2, max_bins=10), f"{path}/scratch").save(spark, f"{path}/model")
    batch_predict(spark, f"{path}/model", "gbm", d, f"{path}/out", ["event_id"])
    parts = F.split("value", "\t")
    return spark.read.text(f"{path}/out").select(parts[0].cast("long").alias("event_id"), F.round(parts[1].cast("double"), 6).alias("prediction"))


from . import queries_more  # noqa: E402, F401  registers its queries

"""Further queries: splits and samples, signatures, windows from configurations, sources and sinks, planning helpers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import lists as L
from .functions import scalars as S
from .operators import prep
from .plans import frames
from .plans.planner import UnknownOperator, compile_program, feature_name, split_stages
from .plans.schema import load_schema
from .queries import _HOT, EVENT_STAR, FRAMES, ORACLES, TRADE, _entity, _rounded, _scratch, event_program, query, read, trade_program, window_sql
from .sources import tables as sources


def uniform_sql(key: str, seed: int = 0) -> str:
    """hash_uniform in SQL."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / {float(1 << 52)!r})"


_U = uniform_sql("o_orderkey::VARCHAR")


def _sides(left, right, names):
    return left.select("o_orderkey", F.lit(names[0]).alias("side")).unionByName(right.select("o_orderkey", F.lit(names[1]).alias("side")))


# splits, samples, row numbers -------------------------------------------------------------------------------------------


@query(
    "temporal_split",
    f"""WITH c AS (SELECT quantile_disc(o_orderdate, 0.8) AS cut FROM orders),
       r AS (SELECT cut, least(greatest((0.8 * count(o_orderdate) - count(*) FILTER (WHERE o_orderdate < cut)) / count(*) FILTER (WHERE o_orderdate = cut), 0), 1) AS ratio FROM orders, c GROUP BY cut)
       SELECT o_orderkey, CASE WHEN o_orderdate < cut OR o_orderdate = cut AND {_U} < ratio THEN 'train' ELSE 'test' END AS side FROM orders, r""",
)
def temporal_split(spark, sf_dir):
    return _sides(*prep.temporal_split(read(spark, sf_dir, "orders"), "o_orderdate", 0.8, "o_orderkey", 100_000), ("train", "test"))


@query("random_split", f"SELECT o_orderkey, CASE WHEN {_U} < 0.7 THEN 'left' ELSE 'right' END AS side FROM orders")
def random_split(spark, sf_dir):
    return _sides(*prep.random_split(read(spark, sf_dir, "orders"), 0.7, "o_orderkey"), ("left", "right"))


@query("recent_rows", "SELECT o_orderkey FROM orders, (SELECT min(o_orderdate) AS cut FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS i, count(*) OVER () AS n FROM orders) WHERE i >= n - 5000) WHERE o_orderdate > cut")
def recent_rows(spark, sf_dir):
    return prep.recent_rows(read(spark, sf_dir, "orders"), "o_orderdate", 5000).select("o_orderkey")


@query("recent_rows_of_one_time", f"SELECT o_orderkey FROM orders WHERE {_U} >= 1 - 5000 / (SELECT count(*) FROM orders)")
def recent_rows_of_one_time(spark, sf_dir):
    """All rows have one time: a share of them is kept."""
    orders = read(spark, sf_dir, "orders").withColumn("t", F.to_timestamp(F.lit("2020-01-01")))
    return prep.recent_rows(orders, "t", 5000, "o_orderkey").select("o_orderkey")


@query("validation_split_of_one_time", f"SELECT o_orderkey, CASE WHEN {_U} < 0.8 THEN 'train' ELSE 'valid' END AS side FROM orders")
def validation_split_of_one_time(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("t", F.to_timestamp(F.lit("2020-01-01")))
    return _sides(*prep.validation_split(orders, "t", 0.2, "o_orderkey"), ("train", "valid"))


@query("old_new_split_by_share", f"SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1996-01-01' AND {_U} < 0.3 THEN 'old' ELSE 'new' END AS side FROM orders")
def old_new_split_by_share(spark, sf_dir):
    return _sides(*prep.old_new_split(read(spark, sf_dir, "orders"), "o_orderdate", 820454400_000_000, 0.3, "o_orderkey"), ("old", "new"))


@query("row_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index FROM lineitem")
def row_index(spark, sf_dir):
    return prep.assign_index(read(spark, sf_dir, "lineitem"), order=["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "row_index")


@query("shuffle_rows", f"SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql('o_orderkey::VARCHAR', 3)}, o_orderkey) - 1 AS place FROM orders")
def shuffle_rows(spark, sf_dir):
    """The rows in shuffled order, with their places in it."""
    df = prep.shuffled(read(spark, sf_dir, "orders"), 8, "o_orderkey", 3).withColumn("u", prep.hash_uniform(F.col("o_orderkey"), 3))
    return prep.assign_index(df.select("o_orderkey", "u"), "place", ["u", "o_orderkey"]).select("o_orderkey", "place")


# signatures and pass-through --------------------------------------------------------------------------------------------


@query("discrete", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS one, string_split(replace(o_orderpriority, '-', ' '), ' ')[1] AS first, len(string_split(replace(o_orderpriority, '-', ' '), ' ')) AS n FROM orders")
def discrete(spark, sf_dir):
    """Signatures are equal just where the values are: each row with the smallest key of its signature, and the text that has its first part's."""
    from pyspark.sql import Window

    df = trade_program(spark, sf_dir, "discrete(orders.o_orderpriority)\ndiscrete(split(orders.words,32))", ["one", "many"])
    words = read(spark, sf_dir, "orders").select(F.explode(S.split(F.translate("o_orderpriority", "-", " "), " ")).alias("first")).distinct()
    first = words.select("first", S.discrete(F.col("first")).alias("sign"))
    df = df.withColumn("one", F.min("o_orderkey").over(Window.partitionBy("one"))).withColumn("sign", F.get("many", F.lit(0)))
    return df.join(F.broadcast(first), "sign").select("o_orderkey", "one", "first", F.size("many").cast("long").alias("n"))


@query("pass_through", "SELECT o_orderkey, o_totalprice AS price, o_custkey AS customer FROM orders")
def pass_through(spark, sf_dir):
    return trade_program(spark, sf_dir, "output(orders.o_totalprice)\ncolumn(orders.o_custkey)", ["price", "customer"])


@query("unknown_function", "SELECT 'nosuch' AS name")
def unknown_function(spark, sf_dir):
    """A name that is no operator is reported, not guessed at."""
    try:
        trade_program(spark, sf_dir, "nosuch(orders.o_totalprice)", ["x"])
    except UnknownOperator as e:
        return spark.createDataFrame([(str(e),)], "name string")
    return spark.createDataFrame([], "name string")


_LINES_BY = "l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("lists_of_lines", f"SELECT l_orderkey, string_agg(CASE WHEN l_linenumber = 2 THEN 'none' ELSE l_returnflag END, '+' ORDER BY {_LINES_BY}) AS flags, string_agg((l_quantity * 2)::INT::VARCHAR, ';' ORDER BY {_LINES_BY}) AS doubled, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY 1")
def lists_of_lines(spark, sf_dir):
    """join, foreach and where over each order's lines."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"))))
    df = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    doubled = L.foreach(F.col("rows.l_quantity"), lambda q: (q * 2).cast("int").cast("string"))
    return df.select("l_orderkey", S.join_window(F.col("rows.flag"), "+", "none").alias("flags"), F.array_join(doubled, ";").alias("doubled"), L.count_of_window(L.where(F.col("rows.l_quantity"), lambda q: q > 25)).alias("large"))


_STAGED = "combine(orders.o_orderstatus,multi_direct(orders,customer.c_mktsegment))\nadd(orders.o_totalprice,multi_direct(orders,customer.c_acctbal))\noriginal(orders.o_custkey)"


@query("two_stages", "SELECT o_orderkey, c_mktsegment AS a, c_acctbal AS b, 2 AS columns, 3 AS signs, concat_ws(',', o_orderstatus, c_mktsegment) AS x FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def two_stages(spark, sf_dir):
    """The joined calls as a stage of columns, and the first line of the stage over them."""
    from .plans.dsl import parse_program

    columns, signs = split_stages(parse_program(_STAGED))
    df = trade_program(spark, sf_dir, "\n".join([*map(str, columns), str(signs[0])]), ["a", "b", "x"])
    return df.withColumn("columns", F.lit(len(columns))).withColumn("signs", F.lit(len(signs)))


# windows ----------------------------------------------------------------------------------------------------------------

_CONFIGURED = {"r10": "10", "d1": "1d,100", "d7": "7d,20", "lagged": "7d,100:1d", "open": "7d"}


@query("window_from_config", window_sql("max", "value"))
def window_from_config(spark, sf_dir):
    """The frames of the other window queries, as a configuration has them."""
    lines = "\n".join(f"window_max(events.ts,events.user_id,{frames.from_config(_CONFIGURED[n])},events.value)" for n in FRAMES)
    return _rounded(event_program(spark, sf_dir, lines, list(FRAMES)), 6)


_UNITS = {"s": "604800s", "m": "10080m", "h": "168h", "d": "7d", "w": "1w", "y": "1y"}


@query("window_units", f"SELECT event_id, {', '.join(f'max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {365 if u == 'y' else 7} DAY PRECEDING AND CURRENT ROW) AS {u}' for u in _UNITS)} FROM events")
def window_units(spark, sf_dir):
    """One length in all units, and a year."""
    lines = "\n".join(f"window_max(events.ts,events.user_id,{w}:2147483647:0s,events.value)" for w in _UNITS.values())
    return event_program(spark, sf_dir, lines, list(_UNITS))


@query("window_auto_sliced", ORACLES["window_sliced"])
def window_auto_sliced(spark, sf_dir):
    """Keys are found to be hot, and so dealt by slices of time."""
    df = compile_program(EVENT_STAR, "\n".join(_HOT), {"events": read(spark, sf_dir, "events")}, names=["day", "most", "lagged"], order=("event_id",), sliced="auto")
    return _rounded(df, 4, ("most",))


@query(
    "window_choice",
    """WITH c AS (SELECT unnest([7200, 36000, 172800, 604800, 1209600, 2764800, 5529600, 31622400]) AS s), e AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS span FROM events)
       SELECT (row_number() OVER (ORDER BY s DESC) - 1)::INT AS place, s || 's,1000:3600s' AS "window" FROM (SELECT s FROM c, e WHERE s < span AND s > 7200 ORDER BY s DESC LIMIT 2)""",
)
def window_choice(spark, sf_dir):
    """The windows that suit the events' times, an hour late."""
    gaps = prep.time_gaps(read(spark, sf_dir, "events"), "ts").first()
    found = frames.candidate_windows(gaps.least_gap / 1e6, (gaps.last - gaps.first) / 1e6, "1h")
    return spark.createDataFrame(list(enumerate(found)), "place int, window string")


# sources and sinks ------------------------------------------------------------------------------------------------------


@query("source_libsvm", "SELECT c_nationkey::DOUBLE AS label, c_acctbal AS x1, c_custkey::DOUBLE AS x2 FROM customer")
def source_libsvm(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    path = _scratch(spark, "libsvm")
    line = F.concat_ws(" ", F.col("c_nationkey").cast("string"), F.concat(F.lit("1:"), F.col("c_acctbal").cast("string")), F.concat(F.lit("2:"), F.col("c_custkey").cast("string")))
    read(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    x = vector_to_array("features")
    return sources.read_table(spark, path, "libsvm").select("label", x[0].alias("x1"), x[1].alias("x2"))


_ENCODED = {
    "target_entity": "o", "target_entity_index": "o_orderkey",
    "entity_detail": {"o": {"features": [*_entity({"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}, "o")["features"], {"id": "o.o_orderstatus", "feature_type": "string", "data_type": "SingleString", "skip": True}, {"id": "o.kv", "feature_type": "string", "data_type": "KVString(|)[:]"}, {"id": "o.words", "feature_type": "string", "data_type": "ArrayString( )"}]}},
}


@query("encode_rows", "SELECT o_orderkey, o_custkey, o_totalprice, 'p=' || o_orderpriority || ';s=' || o_orderstatus AS kv, replace(replace(o_orderpriority, '-', ' '), ' ', ';') AS words, 5 AS columns FROM orders")
def encode_rows(spark, sf_dir):
    """Texts in a declared table's types: numbers, key-value lists, word lists; a skipped column is left out."""
    kv = F.concat(F.lit("p:"), F.col("o_orderpriority"), F.lit("|s:"), F.col("o_orderstatus"))
    texts = read(spark, sf_dir, "orders").select(*(F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")), kv.alias("kv"), F.translate("o_orderpriority", "-", " ").alias("words"))
    df = sources.encode(texts, load_schema(_ENCODED), "o")
    pairs = F.array_join(F.transform("kv", lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return df.withColumn("columns", F.lit(len(df.columns))).withColumn("kv", pairs).withColumn("words", F.array_join("words", ";"))


@query("cache_file", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def cache_file(spark, sf_dir):
    return sources.cache(read(spark, sf_dir, "nation").where("n_regionkey < 3"), _scratch(spark, "cache")).select("n_nationkey", "n_name")


@query("split_folders", "SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'train' ELSE 'test' END AS side FROM orders")
def split_folders(spark, sf_dir):
    path = _scratch(spark, "folders")
    sources.write_split(*prep.old_new_split(read(spark, sf_dir, "orders"), "o_orderdate", 820454400_000_000, 1.0), path)
    return _sides(spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test"), ("train", "test"))


@query("table_statement", "SELECT * FROM (VALUES (0, 'c_custkey', 'bigint'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'int'), (3, 'c_acctbal', 'double'), (4, 'c_mktsegment', 'string')) t(place, name, type)")
def table_statement(spark, sf_dir):
    """The columns of a generated CREATE TABLE statement, as Spark parses them."""
    from pyspark.sql import types as T

    text = sources.create_table(load_schema(TRADE), "customer")
    struct = T.StructType.fromDDL(text[text.index("(") + 1 : text.index(") USING parquet")])
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(struct.fields)], "place int, name string, type string")


@query("artifacts", "SELECT * FROM (VALUES (0, 'combine_orders_o_orderstatus_multi_direct_orders_customer_c_mktsegment'), (1, 'add_orders_o_totalprice_multi_direct_orders_customer_c_acctbal'), (2, 'original_orders_o_custkey')) t(place, name)")
def artifacts(spark, sf_dir):
    """The selected program as it was written, line by line."""
    from .plans.dsl import parse_program

    path = _scratch(spark, "artifacts")
    sources.write_artifacts(spark, path, TRADE, _STAGED)
    ops = json.loads(spark.read.text(path).first()[0])["ops"]
    return spark.createDataFrame([(i, feature_name(parse_program(x)[0])) for i, x in enumerate(ops)], "place int, name string")


# planning and learning --------------------------------------------------------------------------------------------------


@query("resources", """WITH b AS (SELECT (SELECT count(*) FROM orders) * 168 AS main, (SELECT count(*) FROM customer) * 104 + (SELECT count(*) FROM lineitem) * 152 AS side)
SELECT (main * 2 + side)::BIGINT AS shuffle_bytes, greatest(1, ceil((main * 2 + side) / 1048576.0))::BIGINT AS shuffle_partitions, greatest(1, ceil(ceil((main * 2 + side) / 1048576.0) / 16))::BIGINT AS executors FROM b""")
def resources(spark, sf_dir):
    """What the trade star asks for in two scopes with partitions of 1 MB."""
    from .plans.resources import estimate

    r = estimate(load_schema(TRADE), {t: read(spark, sf_dir, t).count() for t in ("orders", "customer", "lineitem")}, 2, partition_mb=1, most_executors=None)
    return spark.createDataFrame([(r.shuffle_bytes, r.shuffle_partitions, r.executors)], "shuffle_bytes long, shuffle_partitions long, executors long")


@query("ml_ftrl")
def ml_ftrl(spark, sf_dir):
    """Predictions of a model learned pass by pass until the validation score falls."""
    from .ml.ftrl import FTRL, FTRLConfig
    from .queries import _labelled

    train, valid = prep.validation_split(_labelled(spark, sf_dir), "ts", 0.2, "event_id")
    model = FTRL.fit(train, valid, FTRLConfig("label", ["value"], ["segment", "event_type"], max_iter=6, decay=0.9, least_show=2.0))
    return FTRL.loads(model.dumps()).predict(valid).select("event_id", F.round("prediction", 3).alias("prediction"))

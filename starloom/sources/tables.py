"""Reading and writing tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.frames import UNLIMITED, from_config, parse_frame
from ..plans.schema import Schema, load_schema


def read_table(spark: SparkSession, path: str, data_type: str = "parquet", schema: Schema | None = None, table: str = "", header: bool = False) -> DataFrame:
    """A parquet, csv, tsv or libsvm table; the declared schema is required for csv and tsv and checked for parquet."""
    if data_type == "parquet":
        df = spark.read.parquet(path)
        if schema:
            schema.validate(table, df.schema)
        return df
    if data_type in ("csv", "tsv"):
        if not schema:
            raise ValueError(f"{data_type} needs a declared schema")
        return spark.read.schema(schema.struct(table)).option("sep", "," if data_type == "csv" else "\t").option("header", header).csv(path)
    if data_type == "libsvm":
        return spark.read.format("libsvm").load(path)
    raise ValueError(f"unknown data type {data_type}")


def encode(df: DataFrame, schema: Schema, table: str) -> DataFrame:
    """Declared columns in declared types; multi-valued texts as arrays or maps, skipped columns left out."""
    out = []
    for c in schema.tables[table]:
        if c.kind == "ignore":
            continue
        x = F.col(c.name).try_cast(c.feature_type if c.feature_type != "long" else "bigint")
        if c.kind == "multi":
            from ..functions.scalars import split, split_key, split_value

            seps = c.separators
            if len(seps) == 1:
                x = split(F.col(c.name), seps[0])
            else:
                values = split_value(F.col(c.name), *seps)
                if c.data_type.startswith("KVNum"):
                    values = F.transform(values, lambda v: v.try_cast("double"))
                x = F.arrays_zip(split_key(F.col(c.name), *seps).alias("key"), values.alias("value"))
        out.append(x.alias(c.name))
    return df.select(*out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and Spark runs in one process, a temporary one that goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_folder()}"


@lru_cache(1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="starloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cache(df: DataFrame, uri: str = "mem://") -> DataFrame:
    """Keeps df for reuse: mem:// in memory (and on disk beyond it), file://path as Parquet."""
    if uri.startswith("mem:"):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = uri.partition("?")[0]
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def write_split(train: DataFrame, test: DataFrame, path: str) -> None:
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")


def write_predictions(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """Text lines of the columns."""
    df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value")).write.mode("overwrite").text(path)


_DDL = {"string": "STRING", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def create_table(schema: Schema, table: str, buckets: int = 0) -> str:
    """A CREATE TABLE statement; the keys of the table's relations become buckets, its time and window reach properties."""
    columns = ", ".join(f"`{c.name}` {_DDL[c.feature_type]}" for c in schema.tables[table])
    out = f"CREATE TABLE `{table}` ({columns}) USING parquet"
    relations = [r for r in schema.relations if r.to_entity == table]
    keys = relations[0].to_keys if relations else (schema.index,) if table == schema.target and schema.index else ()
    if buckets and keys:
        out += f" CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) INTO {buckets} BUCKETS"
    properties = {}
    times = [r.to_time for r in relations if r.to_time]
    if times:
        properties["ts"] = times[0]
        frames = [parse_frame(from_config(w)) for r in relations for w in r.windows]
        spans = [f.high // 1_000_000 for f in frames if f.kind == "range"]
        rows = [f.high if f.kind == "rows" else f.max_rows for f in frames]
        if spans:
            properties["ttl_seconds"] = str(max(spans))
        if rows and max(rows) < UNLIMITED:
            properties["ttl_rows"] = str(max(rows))
    if properties:
        out += " TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")"
    return out


def write_artifacts(spark: SparkSession, path: str, config: str | dict, program: str) -> None:
    """The selected program, its stages, the feature SQL and the table configuration, one JSON line in a text folder."""
    from ..plans.dsl import parse_program
    from ..plans.planner import split_stages
    from ..plans.sqltext import to_sql

    schema = load_schema(config)
    lines = parse_program(program)
    columns, signs = split_stages(lines)
    info = {t: [{"name": c.name, "type": c.feature_type} for c in cs] for t, cs in schema.tables.items()}
    text = json.dumps({"ops": [str(x) for x in lines], "column_stage": [str(c) for c in columns], "sign_stage": [str(s) for s in signs], "sql": to_sql(schema, lines), "tableInfo": info})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def filter_tables(spark: SparkSession, main_path: str, targets: list[dict]) -> list[int]:
    """For each target (input_path, output_path, from_entity_keys, to_entity_keys): the side rows whose keys occur in main, written; returns their numbers."""
    from ..operators.joins import semi_join_filter

    main, out = spark.read.parquet(main_path), []
    for t in targets:
        kept = semi_join_filter(spark.read.parquet(t["input_path"]), main, list(zip(t["from_entity_keys"], t["to_entity_keys"])))
        kept.write.mode("overwrite").parquet(t["output_path"])
        out.append(spark.read.parquet(t["output_path"]).count())
    return out

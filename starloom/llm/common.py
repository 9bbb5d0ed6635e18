"""Spark helpers shared by the training-data operators: shared-folder tables, Arrow column maps, skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows a table may have to be broadcast as a lookup side; a larger one is shuffled.
BROADCAST_ROWS = 20_000
#: A key with more than this share of the rows counts as hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001

_LEFT: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _LEFT:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and Spark runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='starloom-')}"


class Workspace:
    """Tables of one operator run, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _LEFT.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts the lineage with files every executor can read."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark context, so that they need no installed copy."""
    sc = spark.sparkContext
    if getattr(sc, "_starloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="starloom-")) / "starloom_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._starloom_shipped = True


#: Arrow batches of all operators; plans are lazy, so one bound holds for all of them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts still fits a worker. Smaller limits of the session stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


_HASHES = 1 << 60


def hash_share(columns: list[str], wanted: int, rows: Column) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``rows`` rows, by a hash of its columns; never an empty share."""
    share = F.least(F.lit(1.0), F.lit(float(wanted)) / F.greatest(rows, F.lit(1)))
    return F.pmod(F.xxhash64(*columns), F.lit(_HASHES)) < F.ceil(share * float(_HASHES))


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with new columns computed from each Arrow batch; make() runs once in each task.

    A column of df that has the name of a new one is replaced; all other columns pass through.
    """
    arrow_limits(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    out = T.StructType([*(df.schema.fields[i] for i in keep), *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for b in batches:
            if not b.num_rows:
                continue
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(call(b), types)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *made], names=[f.name for f in out.fields])

    return df.mapInArrow(run, out)


def lookup_join(df: DataFrame, table: DataFrame, key: str, how: str = "left", sizes: DataFrame | None = None, total: int | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """Join df to a table with one row per key, whatever share of df one key holds.

    sizes: (key, n) with the number of df's rows of each key; keys over hot_share of total are broadcast (at most
    1 / hot_share of them), all others are joined by a shuffle in which no key has more than that share. how: left or inner.
    """
    if sizes is None:
        sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if total is None:
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mark = fresh([*df.columns, *table.columns], "hot_key")
    hot = sizes.where((F.col("n") > max(1, int(total * hot_share))) & F.col(key).isNotNull()).select(F.col(key).alias(mark))
    hot_side = table.join(F.broadcast(hot), table[key] == hot[mark], "left_semi")
    values = [c for c in table.columns if c != key]
    names = df.columns
    marked = df.join(F.broadcast(hot), df[key] == hot[mark], "left")
    mapped = F.col(mark).isNotNull() | F.col(key).isNull()  # null keys match nothing and need no shuffle
    warm = marked.where(mapped).drop(mark).join(F.broadcast(hot_side), key, how)
    cold = marked.where(~mapped).drop(mark).join(table.hint("shuffle_merge"), key, how)
    cols = [*names, *values]
    return warm.select(*cols).unionByName(cold.select(*cols))


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, that of the files for a scan; nothing is read. Of other plans it may be far too large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

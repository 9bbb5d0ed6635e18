"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed over cells of source, language and topic. Each margin has target tokens for each of its values; the
cells' weights are raked to one margin after another until all margins hold, with every weight at most 1, since documents are
sampled without replacement. A document's weight is its cell's; it is sampled if a hash of its doc_id falls under it.

Targets: ``tempered`` shares. A value's target is min(its tokens, c * tokens^alpha), with the c for which all targets sum to
``fraction`` of the corpus; alpha 1 keeps the mix, 0 makes it even.
Values without a target get none of the sample. Targets that still miss after the last round, and targets of values without tokens,
are reported by a ``MarginWarning`` with the largest miss of each margin; weights are then those of the last round.
The topic of a document is its most frequent word of five bytes or more (ties: smaller hash), hashed to ``topics`` classes.

Defined results: null source or lang is a value of its own; documents without words (null, empty) weigh nothing: probability 1,
always sampled, as they change no margin; a document without long words has topic -1; rows with equal doc_id are sampled
together; an empty table gives an empty result; other columns pass through, those with the names of new ones are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Workspace, append_columns, fresh, lookup_join, ship
from .kernels import U, chunks, words

MARGINS = ("source", "lang", "topic")
#: Cells that are raked on the driver; more are raked in Spark, by the same steps.
DRIVER_CELLS = 200_000
#: Cells of a task when raking in Spark.
SPARK_CELLS = 250_000
#: Raking stops after so many rounds, or when all steps of a round are within the tolerance.
ROUNDS, TOLERANCE = 500, 1e-9
_NULL = "\u0000null"
_RESULTS = ("__tokens", "__topic", "__probability", "__sampled")


def with_topics(docs: DataFrame, topics: int = 8) -> DataFrame:
    """docs with __tokens (words) and __topic."""
    at = docs.columns.index("text")

    def make() -> Callable:
        def call(b: pa.RecordBatch) -> list:
            texts = [None if x is None else x.decode("utf-8", "replace") for x in b.column(at).cast(pa.binary()).to_pylist()]
            tokens, topic = [], []
            for lo, hi in chunks([len(t or "") for t in texts]):
                h, offsets, length = words(texts[lo:hi])
                tokens += np.diff(offsets).tolist()
                doc = np.repeat(np.arange(hi - lo), np.diff(offsets))[length >= 5]
                h = h[length >= 5]
                order = np.lexsort((h, doc))
                d, w = doc[order], h[order]
                begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.empty(0, np.int64)
                n = np.diff(np.r_[begin, len(d)])
                d, w = d[begin], w[begin]
                best = np.lexsort((w, -n, d))
                first = best[np.r_[True, d[best][1:] != d[best][:-1]]] if len(d) else best
                out = np.full(hi - lo, -1, np.int64)
                out[d[first]] = (w[first] % U(topics)).astype(np.int64)
                topic += out.tolist()
            return [tokens, topic]

        return call

    return append_columns(docs, [T.StructField("__tokens", T.LongType()), T.StructField("__topic", T.LongType())], make)


def tempered(tokens: dict[str, float], alpha: float, budget: float) -> dict[str, float]:
    """Target tokens of each value."""
    names = sorted(k for k, v in tokens.items() if v > 0)
    have = np.array([tokens[k] for k in names])
    if not names or budget >= have.sum():
        return dict(zip(names, have.tolist()))
    lo, hi = 0.0, float((have ** (1 - alpha)).max())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(have, mid * have**alpha).sum() < budget else (lo, mid)
    return dict(zip(names, np.minimum(have, hi * have**alpha).tolist()))


class MarginWarning(UserWarning):
    """Margins that the weights do not meet."""


def _factors(sums: Callable[[int, list[np.ndarray]], np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float) -> list[np.ndarray]:
    """The factor of each margin's values. sums(k, factors): weighted tokens of margin k's values. Margins that are not met are warned of."""

    def miss(got: np.ndarray, target: np.ndarray) -> float:
        """Relative to the target; to the whole margin where the target is zero."""
        off = np.where(target > 0, np.abs(got - target) / np.where(target > 0, target, 1.0), got / max(target.sum(), 1e-300))
        return float(off.max(initial=0))

    factors = [np.ones(len(t)) for t in targets]
    for _ in range(rounds):
        worst = 0.0
        for k, target in enumerate(targets):
            got = sums(k, factors)
            step = np.where(got > 0, target / np.maximum(got, 1e-300), 1.0)
            worst = max(worst, float(np.abs(step - 1)[target > 0].max(initial=0)), miss(got[target <= 0], target[target <= 0]))
            factors[k] = np.clip(factors[k] * step, 1e-12, 1e12)
        if worst < tolerance:
            break
    missed = {k: m for k, target in enumerate(targets) if (m := miss(sums(k, factors), target)) > tolerance}
    if missed:
        said = ", ".join(f"{MARGINS[k] if len(targets) == len(MARGINS) else k} by up to {m:.1e}" for k, m in missed.items())
        warnings.warn(f"targets missed after {rounds} rounds: {said} of a value's target", MarginWarning, stacklevel=3)
    return factors


def _weights(codes: list[np.ndarray], factors: list[np.ndarray]) -> np.ndarray:
    product = np.ones(len(codes[0]))
    for f, c in zip(factors, codes):
        product *= f[c]
    return np.minimum(1.0, product)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells, at most 1: products of one factor for each margin's value such that each margin gets its target."""

    def sums(k: int, factors: list[np.ndarray]) -> np.ndarray:
        return np.bincount(codes[k], tokens * _weights(codes, factors), len(targets[k]))

    return _weights(codes, _factors(sums, targets, rounds, tolerance))


def _rake_in_spark(cells: DataFrame, n_cells: int, names: dict[str, list[str]], sizes: dict[str, DataFrame], targets: list[np.ndarray], ws: Workspace, rounds: int) -> DataFrame:
    """rake() over a cell table of any size: the cells stay on the executors, the factors of the margins' values on the driver."""
    spark, coded = cells.sparkSession, cells
    for m in MARGINS:
        code = ws.table(spark.createDataFrame(pa.table({m: pa.array(names[m], pa.string()), f"code_{m}": pa.array(range(len(names[m])), pa.int64())})), f"codes-{m}")
        coded = coded.join(F.broadcast(code), m) if len(names[m]) <= BROADCAST_ROWS else lookup_join(coded, code, m, "inner", sizes=sizes[m], total=n_cells)
    coded = ws.table(coded.select("cell", F.col("tokens").cast("double").alias("tokens"), *(f"code_{m}" for m in MARGINS)).repartition(1 + n_cells // SPARK_CELLS, "cell"), "coded")
    ship(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All cells of a partition as one row of bytes."""
        parts = list(batches)
        if parts:
            t = pa.Table.from_batches(parts)
            columns = [t["tokens"].to_numpy().astype(np.float64), *(t[f"code_{m}"].to_numpy().astype(np.int32) for m in MARGINS)]
            yield pa.RecordBatch.from_pydict({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip("abcd", columns)})

    held = coded.drop("cell").mapInArrow(blocks, "a binary, b binary, c binary, d binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(k: int, factors: list[np.ndarray]) -> np.ndarray:
        shared = spark.sparkContext.broadcast(factors)

        def call(block: tuple) -> tuple[np.ndarray, np.ndarray]:
            codes = [np.frombuffer(x, np.int32) for x in block[1:]]
            values, at = np.unique(codes[k], return_inverse=True)
            return values, np.bincount(at, np.frombuffer(block[0], np.float64) * _weights(codes, shared.value), len(values))

        out = np.zeros(len(factors[k]))
        for values, got in held.map(call).collect():
            out[values] += got
        shared.destroy()
        return out

    try:
        shared = spark.sparkContext.broadcast(_factors(sums, targets, rounds, TOLERANCE))
    finally:
        held.unpersist()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = _weights([b.column(f"code_{m}").to_numpy() for m in MARGINS], shared.value)
            yield pa.RecordBatch.from_pydict({"cell": b.column("cell"), "weight": pa.array(weight, pa.float64())})

    return ws.table(coded.mapInArrow(weigh, "cell long, weight double"), "weights")


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(_NULL))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) of each doc_id."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(_NULL)), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def mix_sources(docs: DataFrame, fraction: float = 0.5, alpha: float = 0.5, topics: int = 8, seed: int = 17, targets: dict[str, dict[str, float]] | None = None, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """docs (or only their columns keep) with __tokens, __topic, __probability and __sampled.

    targets: tokens of each margin's values instead of tempered ones. Texts are read once: what is kept is written with its counts.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in _RESULTS]
    source, lang = (fresh(docs.columns, c) for c in ("source_", "lang_"))
    full = with_topics(docs.withColumn(source, _value("source")).withColumn(lang, _value("lang")), topics)
    full = ws.table(full.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, "doc_id"])), source, lang, "__tokens", "__topic"), "counted")
    cell = F.xxhash64(source, lang, "__topic")
    keys = {"source": F.col(source), "lang": F.col(lang), "topic": F.col("__topic").cast("string")}
    counted = full.groupBy(*(v.alias(k) for k, v in keys.items()), cell.alias("cell")).agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    counted = ws.table(counted, "cells")
    cells = counted.where(F.col("tokens") > 0)
    n_cells = cells.count()
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    names, goals, sizes = {}, [], {}
    for m in MARGINS:
        sizes[m] = ws.table(cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"), F.count(F.lit(1)).alias("n")), f"margin-{m}")
        have = sizes[m].select(m, "have").toArrow().sort_by(m)
        names[m] = have[m].to_pylist()
        goal = targets[m] if targets and m in targets else tempered(dict(zip(names[m], have["have"].to_pylist())), alpha, fraction * total)
        goals.append(np.array([goal.get(x, 0.0) for x in names[m]], float))
        absent = sorted(x for x in goal.keys() - set(names[m]) if goal[x] > 0)
        if absent:
            warnings.warn(f"{len(absent)} values of {m} have a target and no tokens: {', '.join(absent[:10])}", MarginWarning, stacklevel=2)
    if not n_cells:
        weights = docs.sparkSession.createDataFrame([], "cell long, weight double")
    elif n_cells <= driver_cells:
        rows = cells.select("cell", "tokens", *MARGINS).toArrow()
        codes = [pc.index_in(rows[m], pa.array(names[m], pa.string())).to_numpy() for m in MARGINS]
        weight = rake(rows["tokens"].to_numpy().astype(float), codes, goals, rounds)
        weights = docs.sparkSession.createDataFrame(pa.table({"cell": rows["cell"], "weight": pa.array(weight, pa.float64())}))
    else:
        weights = _rake_in_spark(cells, n_cells, names, {m: sizes[m].select(m, "n") for m in MARGINS}, goals, ws, rounds)
    key, value = fresh(full.columns, "mix_cell"), fresh(full.columns, "mix_weight")
    full = full.withColumn(key, cell)
    weights = weights.select(F.col("cell").alias(key), F.col("weight").alias(value))
    if n_cells <= BROADCAST_ROWS:
        full = full.join(F.broadcast(weights), key, "left")
    else:
        full = lookup_join(full, weights, key, "left", sizes=counted.select(F.col("cell").alias(key), "n"))
    chance = F.when(F.col("__tokens") == 0, F.lit(1.0)).otherwise(F.coalesce(value, F.lit(1.0)))
    return full.withColumn("__probability", chance).withColumn("__sampled", uniform(F.col("doc_id"), seed) < F.col("__probability")).select(*(F.col(f"`{c}`") for c in kept), *_RESULTS)

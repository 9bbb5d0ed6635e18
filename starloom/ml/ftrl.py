"""Follow-the-regularised-leader learning of sparse linear models, pass by pass.

Features are hashed to 2^``hash_bits`` weights: values of categories, quantile bins of numbers, and a bias. In each pass every
partition starts from the pass's common state, goes over its rows in mini-batches, and reports how it moved the weights it
touched; moves are averaged by how often each partition saw the weight. The state (at most 2^hash_bits rows) is on the driver.
After each pass the shows of a weight decay by ``decay`` and weights with fewer than ``least_show`` are erased; training ends
when a pass after ``min_iter`` does not raise the validation score, or after ``max_iter``; the best state is kept.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cache, shared_folder
from .linear import quantile_cuts, with_bins
from .metrics import auc, binary_metrics, regression_metrics


@dataclass
class FTRLConfig:
    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    task: str = "binary"
    alpha: float = 0.1
    beta: float = 1.0
    lambda_1: float = 0.0
    lambda_2: float = 1e-3
    mini_batch: int = 500
    min_iter: int = 4
    max_iter: int = 8
    decay: float = 1.0
    least_show: float = 0.0
    buckets: tuple[int, ...] = (10, 100)
    hash_bits: int = 18


def weights_of(z: np.ndarray, n: np.ndarray, config: FTRLConfig) -> np.ndarray:
    """The weights that minimise the linearised loss with both penalties; zero where |z| is within lambda_1."""
    rate = (config.beta + np.sqrt(n)) / config.alpha + config.lambda_2
    return np.where(np.abs(z) > config.lambda_1, (np.sign(z) * config.lambda_1 - z) / rate, 0.0)


class FTRL:
    def __init__(self, config: FTRLConfig, cuts: dict[str, list[float]], state: np.ndarray | None = None):
        """state: (3, 2^hash_bits) of z, n and shows."""
        self.config, self.cuts = config, cuts
        self.state = np.zeros((3, 1 << config.hash_bits)) if state is None else state
        self.history: list[float] = []

    @property
    def weights(self) -> np.ndarray:
        return weights_of(self.state[0], self.state[1], self.config)

    def effective_features(self) -> int:
        """Weights that are not zero."""
        return int(np.count_nonzero(self.weights))

    def _placed(self, df: DataFrame, name: str) -> DataFrame:
        """df with the places of each row's weights."""
        c, size = self.config, F.lit(1 << self.config.hash_bits)
        binned = with_bins(df, {f"__b_{x}@{b}": (x, self.cuts[f"{x}@{b}"]) for x in c.numeric for b in c.buckets})
        texts = [F.concat(F.lit(f"{x}="), F.coalesce(F.col(x).cast("string"), F.lit("\u0000"))) for x in c.categorical]
        texts += [F.concat(F.lit(f"{x}@{b}="), F.coalesce(F.col(f"`__b_{x}@{b}`").cast("string"), F.lit("\u0000"))) for x in c.numeric for b in c.buckets]
        return binned.select(*df.columns, F.array(*(F.pmod(F.xxhash64(t), size).cast("int") for t in [F.lit("bias"), *texts])).alias(name))

    @classmethod
    def fit(cls, train: DataFrame, valid: DataFrame, config: FTRLConfig) -> FTRL:
        self = cls(config, quantile_cuts(train, config.numeric, config.buckets))
        y = F.col(config.label).cast("double")
        y = (y > 0).cast("double") if config.task == "binary" else y
        folder = f"{shared_folder(train.sparkSession)}/ftrl-{uuid.uuid4().hex[:12]}"
        rows = cache(self._placed(train.where(F.col(config.label).isNotNull()), "places").select("places", y.alias("y")), f"{folder}/train")
        held = cache(self._placed(valid, "places").select("places", config.label), f"{folder}/valid")
        best, score = self.state, -math.inf
        for k in range(config.max_iter):
            self.state = self._pass(rows)
            scored = self._scored(held, "places")
            now = (auc(scored, "prediction", config.label) or 0.0) if config.task == "binary" else -regression_metrics(scored, "prediction", config.label)["mse"]
            self.history.append(now)
            if now > score:
                best, score = self.state, now
            elif k + 1 >= config.min_iter:
                break
        self.state = best
        return self

    def _pass(self, rows: DataFrame) -> np.ndarray:
        config, state = self.config, self.state
        shared = rows.sparkSession.sparkContext.broadcast(state[:2])
        alpha, beta, l1, l2, binary, size = config.alpha, config.beta, config.lambda_1, config.lambda_2, config.task == "binary", config.mini_batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, n = shared.value[0].copy(), shared.value[1].copy()
            shows = np.zeros(len(z))
            for b in batches:
                ys = b.column(1).to_numpy()
                places = np.asarray(b.column(0).flatten()).reshape(len(ys), -1) if len(ys) else np.empty((0, 1), np.int64)
                for at in range(0, len(ys), size):
                    p, y = places[at : at + size], ys[at : at + size]
                    own, where = np.unique(p, return_inverse=True)
                    where = where.reshape(p.shape)
                    w = np.where(np.abs(z[own]) > l1, (np.sign(z[own]) * l1 - z[own]) / ((beta + np.sqrt(n[own])) / alpha + l2), 0.0)
                    margin = w[where].sum(axis=1)
                    off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) if binary else margin) - y
                    times = np.bincount(where.ravel(), minlength=len(own))
                    g = np.bincount(where.ravel(), np.repeat(off, p.shape[1]), len(own)) / np.sqrt(times)  # a step of the batch, whatever its size
                    z[own] += g - (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / alpha * w
                    n[own] += g * g
                    shows[own] += times
            seen = np.flatnonzero(shows)
            yield pa.RecordBatch.from_pydict({"i": pa.array(seen.astype(np.int32)), "z": pa.array((z - shared.value[0])[seen]), "n": pa.array((n - shared.value[1])[seen]), "shows": pa.array(shows[seen])})

        moved = rows.mapInArrow(run, "i int, z double, n double, shows double")
        mean = lambda c: (F.sum(F.col(c) * F.col("shows")) / F.sum("shows")).alias(c)
        got = moved.groupBy("i").agg(mean("z"), mean("n"), F.sum("shows").alias("shows_")).toArrow()
        i = got["i"].to_numpy()
        new = np.stack([state[0], state[1], state[2] * config.decay])
        for row, c in enumerate(("z", "n", "shows_")):
            new[row][i] += got[c].to_numpy()
        new[:, new[2] < config.least_show] = 0.0
        return new

    def predict(self, df: DataFrame) -> DataFrame:
        """df with logit and prediction (a probability, or the label's own scale)."""
        return self._scored(self._placed(df, "__places"), "__places").drop("__places")

    def _scored(self, df: DataFrame, name: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.weights)

        @F.arrow_udf("double")
        def score(places: pa.Array) -> pa.Array:
            rows = np.asarray(places.flatten()).reshape(len(places), -1) if len(places) else np.empty((0, 1), np.int64)
            return pa.array(shared.value[rows].sum(axis=1))

        out = df.withColumn("logit", score(name))
        return out.withColumn("prediction", 1 / (1 + F.exp(-F.col("logit"))) if self.config.task == "binary" else F.col("logit"))

    def evaluate(self, df: DataFrame) -> dict:
        return (binary_metrics if self.config.task == "binary" else regression_metrics)(self.predict(df), "prediction", self.config.label)

    def dumps(self) -> str:
        i = np.flatnonzero(self.state.any(axis=0))
        return json.dumps({"config": self.config.__dict__, "cuts": self.cuts, "places": i.tolist(), "state": [[float(x).hex() for x in row[i]] for row in self.state]})

    @classmethod
    def loads(cls, text: str) -> FTRL:
        data = json.loads(text)
        config = FTRLConfig(**{**data["config"], "buckets": tuple(data["config"]["buckets"])})
        state = np.zeros((3, 1 << config.hash_bits))
        for row, xs in zip(state, data["state"]):
            row[data["places"]] = [float.fromhex(x) for x in xs]
        return cls(config, data["cuts"], state)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FTRL:
        return cls.loads(spark.read.text(path).first()[0])

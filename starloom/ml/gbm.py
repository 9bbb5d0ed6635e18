"""Gradient-boosted trees on histograms: logistic loss, level by level, missing values sent to the better side.

Rows stay in Spark: each level sums gradients by (node, feature, bin) for the smaller child of every split (the sibling is the
parent minus it) and the driver, which sees at most nodes * features * bins sums, picks the splits.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .linear import quantile_cuts


@dataclass
class TreeConfig:
    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    trees: int = 10
    max_depth: int = 5
    max_leaves: int = 10_000
    max_bins: int = 250
    max_categories: int = 250
    min_child_weight: float = 0.0
    min_child_n: int = 0
    min_child_ratio: float = 0.0
    min_split_gain: float = 0.0
    lambda_0: float = 0.0
    lambda_2: float = 1e-6
    learning_rate: float = 0.3
    row_sample: float = 1.0
    column_sample: float = 1.0
    seed: int = 7


@dataclass
class Node:
    depth: int
    n: int = 0
    weight: float = 0.0
    feature: str | None = None
    value: object = None
    bin: int = -1
    discrete: bool = False
    missing_right: bool = False
    gain: float = 0.0
    left: int = -1
    right: int = -1


class GBM:
    def __init__(self, config: TreeConfig, cuts: dict[str, list[float]], categories: dict[str, list[str]], trees: list[list[Node]] | None = None, bias: float = 0.0):
        self.config, self.cuts, self.categories, self.trees, self.bias = config, cuts, categories, trees or [], bias

    # binning

    def binned(self, df: DataFrame) -> DataFrame:
        """df with a bin number for each feature: bin i of a number holds values over cut i - 1 up to cut i; -1 is missing."""
        for i, c in enumerate(self.config.numeric):
            cuts = self.cuts[c]
            splits = [-math.inf, *(-x for x in reversed(cuts)), math.inf]
            df = df.withColumn(f"__neg{i}", -F.col(c).cast("double"))
            df = Bucketizer(splits=splits, inputCol=f"__neg{i}", outputCol=f"__bucket{i}", handleInvalid="keep").transform(df) if cuts else df.withColumn(f"__bucket{i}", F.when(F.col(c).isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
            m = len(cuts)
            df = df.withColumn(f"__b{i}", F.when(F.col(f"__bucket{i}") <= m, F.lit(m) - F.col(f"__bucket{i}")).otherwise(-1).cast("int")).drop(f"__neg{i}", f"__bucket{i}")
        for k, c in enumerate(self.config.categorical):
            i = len(self.config.numeric) + k
            names = self.categories[c]
            at = F.array_position(F.array(*map(F.lit, names)), F.col(c).cast("string")).cast("int") - 1 if names else F.lit(-1)
            df = df.withColumn(f"__b{i}", F.coalesce(at, F.lit(-1)))
        return df

    # training

    @classmethod
    def fit(cls, df: DataFrame, config: TreeConfig, scratch: str | None = None) -> GBM:
        from ..operators.prep import hash_uniform, top_categories

        spark = df.sparkSession
        cuts = {k.rpartition("@")[0]: v for k, v in quantile_cuts(df, config.numeric, (config.max_bins,)).items()}
        categories: dict[str, list[str]] = {c: [] for c in config.categorical}
        if config.categorical:
            for r in top_categories(df, config.categorical, config.max_categories).orderBy("feature", "rank").collect():
                categories[r.feature].append(r.value)
        y = (F.col(config.label).cast("double") > 0).cast("double")
        share = df.agg(F.avg(y)).first()[0] or 0.5
        bias = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        self = cls(config, cuts, categories, [], bias)
        features = [*config.numeric, *config.categorical]
        bins = [f"__b{i}" for i in range(len(features))]
        scratch = scratch or f"{shared_folder(spark)}/gbm-{uuid.uuid4().hex[:12]}"
        rows = self.binned(df).where(F.col(config.label).isNotNull()).select(*bins, y.alias("__y"), F.xxhash64(*df.columns).alias("__row"))
        rows = cls._kept(rows.withColumn("__z", F.lit(bias)), f"{scratch}/0")
        rng = np.random.default_rng(config.seed)
        for t in range(config.trees):
            p = 1 / (1 + F.exp(-F.col("__z")))
            sampled = rows if config.row_sample >= 1 else rows.where(hash_uniform(F.col("__row"), config.seed + t) < config.row_sample)
            used = np.sort(rng.permutation(len(features))[: max(1, round(config.column_sample * len(features)))])
            data = sampled.select(*bins, (p - F.col("__y")).alias("__g"), (p * (1 - p)).alias("__h"))
            tree = self._grow(data, features, used.tolist())
            self.trees.append(tree)
            if t + 1 < config.trees:
                rows = cls._kept(rows.withColumn("__z", F.col("__z") + self._walk(tree, True)), f"{scratch}/{t + 1}")
        return self

    @staticmethod
    def _kept(df: DataFrame, path: str) -> DataFrame:
        """Written and read again, so that a tree's plan does not hold all trees before it."""
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def histogram(self, data: DataFrame, tree: list[Node], nodes: list[int], used: list[int]) -> dict[int, np.ndarray]:
        """For each node an array (feature, bin, (g, h, n)); the last bin is missing."""
        width = max([len(c) for c in (*self.cuts.values(), *self.categories.values())], default=0) + 2
        out = {n: np.zeros((len(used), width, 3)) for n in nodes}
        node = self._walk(tree, True, leaf=True) if len(tree) > 1 else F.lit(0)
        placed = data.withColumn("__node", node).where(F.col("__node").isin(nodes))
        long = placed.select("__node", "__g", "__h", F.posexplode(F.array(*(F.col(f"__b{i}") for i in used))).alias("f", "b"))
        for r in long.groupBy("__node", "f", "b").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"), F.count(F.lit(1)).alias("n")).toLocalIterator():
            out[r["__node"]][r.f, r.b] = (r.g, r.h, r.n)  # bin -1 is the last
        return out

    def _grow(self, data: DataFrame, features: list[str], used: list[int]) -> list[Node]:
        c = self.config
        tree = [Node(0)]
        hist = self.histogram(data, tree, [0], used)
        total = hist[0][0].sum(axis=0)
        tree[0].n, tree[0].weight = int(total[2]), -total[0] / (total[1] + c.lambda_2) * c.learning_rate
        least_n, leaves = max(c.min_child_n, c.min_child_ratio * total[2]), 1
        frontier = [0]
        for depth in range(c.max_depth):
            pairs = []
            for k in frontier:
                if leaves >= c.max_leaves:
                    break
                best = self.best_split(hist[k], len(c.numeric), used, least_n)
                if best is None or best[0] <= c.min_split_gain:
                    continue
                gain, f, b, missing_right, left, right = best
                node, name = tree[k], features[used[f]]
                node.gain, node.feature, node.bin, node.missing_right, node.discrete = float(gain), name, int(b), bool(missing_right), used[f] >= len(c.numeric)
                node.value = self.categories[name][b] if node.discrete else self.cuts[name][b]
                node.left, node.right = len(tree), len(tree) + 1
                for side in (left, right):
                    tree.append(Node(depth + 1, int(side[2]), float(-side[0] / (side[1] + c.lambda_2) * c.learning_rate)))
                pairs.append((k, node.left, node.right) if left[2] <= right[2] else (k, node.right, node.left))
                leaves += 1
            if not pairs or depth + 1 == c.max_depth:
                break
            small = self.histogram(data, tree, [p[1] for p in pairs], used)
            hist = {**small, **{big: hist[k] - small[s] for k, s, big in pairs}}
            frontier = sorted(hist)
        return tree

    def best_split(self, hist: np.ndarray, n_numeric: int, used: list[int], least_n: float = 0):
        """(gain, feature, bin, missing goes right, left sums, right sums) of the best valid split, or None."""
        c, best = self.config, None
        loss = lambda a: a[..., 0] ** 2 / (a[..., 1] + c.lambda_2)
        for f in range(len(hist)):
            total, missing, bins = hist[f].sum(axis=0), hist[f][-1], hist[f][:-1]
            if used[f] < n_numeric:
                low = np.cumsum(bins, axis=0)[: max(len(bins) - 1, 0)]
                sides = [(low + missing, False), (low, True)]
            else:
                sides = [(total - bins, False)]  # one category goes right
            for left, missing_right in sides:
                right = total - left
                valid = (left[:, 1] > c.min_child_weight) & (right[:, 1] > c.min_child_weight) & (left[:, 2] > least_n) & (right[:, 2] > least_n)
                if not valid.any():
                    continue
                gain = np.where(valid, loss(left) + loss(right) - loss(total) - c.lambda_0, -np.inf)
                b = int(gain.argmax())
                if best is None or gain[b] > best[0]:
                    best = (gain[b], f, b, missing_right, left[b], right[b])
        return best

    # prediction

    def _walk(self, tree: list[Node], binned: bool, leaf: bool = False, k: int = 0) -> Column:
        """A row's leaf weight (or number), as nested conditions on bins or on the features themselves."""
        node = tree[k]
        if node.left < 0:
            return F.lit(k) if leaf else F.lit(float(node.weight))
        order = [*self.config.numeric, *self.config.categorical]
        if binned:
            b = F.col(f"__b{order.index(node.feature)}")
            left = (b != node.bin) if node.discrete else F.when(b < 0, F.lit(not node.missing_right)).otherwise(b <= node.bin)
        else:
            x = F.col(node.feature)
            left = F.coalesce(x.cast("string") != node.value, F.lit(True)) if node.discrete else F.coalesce(F.when(~F.isnan(x.cast("double")), x.cast("double") <= node.value), F.lit(not node.missing_right))
        return F.when(left, self._walk(tree, binned, leaf, node.left)).otherwise(self._walk(tree, binned, leaf, node.right))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with logit and prediction, a probability."""
        z = F.lit(self.bias)
        for tree in self.trees:
            z = z + self._walk(tree, False)
        return df.withColumn("logit", z).withColumn("prediction", 1 / (1 + F.exp(-F.col("logit"))))

    # models as text

    def dumps(self) -> str:
        """JSON; numbers that must come back exactly are also written in hex."""

        def one(n: Node) -> dict:
            return {**n.__dict__, "weight_hex": float(n.weight).hex(), "value_hex": float(n.value).hex() if isinstance(n.value, float) else None}

        return json.dumps({"config": self.config.__dict__, "bias": float(self.bias).hex(), "cuts": {k: [float(x).hex() for x in v] for k, v in self.cuts.items()}, "categories": self.categories, "n_learner": len(self.trees), "models": [[one(n) for n in t] for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> GBM:
        data = json.loads(text)

        def node(x: dict) -> Node:
            weight, value = float.fromhex(x.pop("weight_hex")), x.pop("value_hex")
            return Node(**{**x, "weight": weight, "value": float.fromhex(value) if value else x["value"]})

        return cls(TreeConfig(**data["config"]), {k: [float.fromhex(x) for x in v] for k, v in data["cuts"].items()}, data["categories"], [[node(n) for n in t] for t in data["models"]], float.fromhex(data["bias"]))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GBM:
        return cls.loads(spark.read.text(path).first()[0])

"""Hyper-parameter search by random draws, trained at most ``concurrency`` at a time on one cached scan."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .linear import LinearConfig, LinearModel


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    scale: str = "uniform"

    def draw(self, rng: random.Random) -> float:
        if self.scale == "log":
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.uniform(self.low, self.high)


def random_search(train: DataFrame, valid: DataFrame, config: LinearConfig, ranges: dict[str, Range], n: int, concurrency: int = 3, seed: int = 0) -> list[dict]:
    """Draws with their scores, best first: AUC, or the negative error on the label's own scale."""
    rng = random.Random(seed)
    draws = [{k: r.draw(rng) for k, r in sorted(ranges.items())} for _ in range(n)]
    train, valid = train.persist(), valid.persist()

    def one(params: dict) -> dict:
        model = LinearModel.fit(train, LinearConfig(**{**config.__dict__, **params}))
        e = model.evaluate(valid)
        return {"params": params, "score": (e["auc"] or 0.0) if config.task == "binary" else -e["mae"]}

    try:
        with ThreadPoolExecutor(concurrency) as pool:
            return sorted(pool.map(one, draws), key=lambda x: -x["score"])
    finally:
        train.unpersist()
        valid.unpersist()

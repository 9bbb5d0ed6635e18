"""Linear models over binned features: logistic and linear regression with L1 and L2 penalties, several bin resolutions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import binary_metrics, regression_metrics


@dataclass
class LinearConfig:
    """lambda_1 and lambda_2 are the penalties of the weights; buckets the bin counts of each numeric feature (none: raw values)."""

    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    task: str = "binary"
    lambda_1: float = 0.0
    lambda_2: float = 1e-3
    max_iter: int = 20
    buckets: tuple[int, ...] = (10, 100)
    hash_bits: int = 18
    link: str = "identity"


LINKS = {"identity": (lambda c: c, lambda c: c), "log1p": (F.log1p, F.expm1), "sigmoid": (lambda c: F.log(c / (1 - c)), lambda c: 1 / (1 + F.exp(-c)))}


def _counted(x: Column, cuts: list[float]) -> Column:
    return F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + F.when(c < x, 1).otherwise(0))


def with_bins(df: DataFrame, wanted: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """df with a column for each name in wanted: how many of the (sorted) cuts are under a column's value; null for null.

    Found by binary search, so time hardly grows with the number of cuts. The search counts the cuts from the other end, as its bins
    hold their lower bound and ours their upper one. Infinite cuts, which it cannot hold, are counted one by one.
    """
    found = {name: (c, cuts) for name, (c, cuts) in wanted.items() if cuts and all(map(math.isfinite, cuts))}
    turned = {c: f"__turned_{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in found.values()))}
    out = df.withColumns({t: F.lit(0.0) - F.col(c).cast("double") for c, t in turned.items()})
    if found:
        splits = [[-math.inf, *(0.0 - c for c in reversed(cuts)), math.inf] for _, cuts in found.values()]
        out = Bucketizer(splitsArray=splits, inputCols=[turned[c] for c, _ in found.values()], outputCols=[f"__at_{n}" for n in found], handleInvalid="keep").transform(out)
    new = {}
    for name, (c, cuts) in wanted.items():
        x, n = F.col(c).cast("double"), len(cuts)
        if name in found:
            at = F.col(f"__at_{name}").cast("int")
            new[name] = F.when(x.isNotNull(), F.when(at > n, n).otherwise(F.lit(n) - at))  # above n: NaN, which is over all numbers
        else:
            new[name] = F.when(x.isNotNull(), _counted(x, cuts) if cuts else F.lit(0))
    return out.select(*df.columns, *(v.alias(k) for k, v in new.items()))


def quantile_cuts(df: DataFrame, columns: list[str], buckets: tuple[int, ...], accuracy: int = 100_000) -> dict[str, list[float]]:
    """Inner cut points of each column and bucket number, all from one pass."""
    wanted = [(c, b) for c in columns for b in buckets]
    if not wanted:
        return {}
    r = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [i / b for i in range(1, b)], accuracy).alias(f"{c}@{b}") for c, b in wanted)).first()
    return {f"{c}@{b}": sorted(set(r[f"{c}@{b}"] or [])) for c, b in wanted}


class LinearModel:
    def __init__(self, config: LinearConfig, cuts: dict[str, list[float]], model: PipelineModel):
        self.config, self.cuts, self.model = config, cuts, model

    @classmethod
    def fit(cls, df: DataFrame, config: LinearConfig) -> LinearModel:
        cuts = quantile_cuts(df, config.numeric, config.buckets)
        data = cls._features(df, config, cuts).where(F.col("__y").isNotNull())
        names = [c for c in data.columns if c.startswith("__x_")]
        total = config.lambda_1 + config.lambda_2
        common = {"featuresCol": "__features", "labelCol": "__y", "maxIter": config.max_iter, "regParam": total, "elasticNetParam": config.lambda_1 / total if total else 0.0}
        learner = LogisticRegression(**common, rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__class") if config.task == "binary" else LinearRegression(**common, predictionCol="__raw")
        encode = FeatureHasher(inputCols=names, outputCol="__features", numFeatures=1 << config.hash_bits) if config.buckets or config.categorical else VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep")
        return cls(config, cuts, Pipeline(stages=[encode, learner]).fit(data))

    @staticmethod
    def _features(df: DataFrame, config: LinearConfig, cuts: dict[str, list[float]]) -> DataFrame:
        new = {f"__x_{c}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in config.categorical}
        df = with_bins(df, {f"__x_{c}@{b}": (c, cuts[f"{c}@{b}"]) for c in config.numeric for b in config.buckets})
        for c in config.numeric:
            if config.buckets:
                new |= {f"__x_{c}@{b}": F.coalesce(F.col(f"`__x_{c}@{b}`").cast("string"), F.lit("\u0000")) for b in config.buckets}
            else:
                new[f"__x_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        if config.label in df.columns:
            y = F.col(config.label).cast("double")
            new["__y"] = (y > 0).cast("double") if config.task == "binary" else LINKS[config.link][0](y)
        return df.withColumns(new)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction (a probability, or the label's own scale) and logit."""
        out = self.model.transform(self._features(df, self.config, self.cuts))
        if self.config.task == "binary":
            new = {"prediction": vector_to_array("__probability")[1], "logit": vector_to_array("__raw")[1]}
        else:
            new = {"prediction": LINKS[self.config.link][1](F.col("__raw")), "logit": F.col("__raw")}
        return out.select(*df.columns, *(v.alias(k) for k, v in new.items()))

    def evaluate(self, df: DataFrame) -> dict:
        measure = binary_metrics if self.config.task == "binary" else regression_metrics
        return measure(self.predict(df), "prediction", self.config.label)

    @property
    def weights(self):
        last = self.model.stages[-1]
        return last.coefficients, last.intercept

    def effective_features(self) -> int:
        """Weights that are not zero."""
        return int(self.weights[0].numNonzeros())

    def save(self, path: str) -> None:
        import json

        self.model.write().overwrite().save(f"{path}/model")
        text = json.dumps({"config": self.config.__dict__, "cuts": self.cuts})
        self.model_session().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def model_session():
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession()

    @classmethod
    def load(cls, path: str) -> LinearModel:
        import json

        data = json.loads(cls.model_session().read.text(f"{path}/metadata").first()[0])
        config = LinearConfig(**{**data["config"], "buckets": tuple(data["config"]["buckets"])})
        return cls(config, data["cuts"], PipelineModel.load(f"{path}/model"))


def drop_rare(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Sets categories seen in fewer than least rows to null, as features too cold to learn from."""
    for c in columns:
        seen = df.groupBy(F.col(c).alias("__c")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("__c")
        df = df.join(seen, F.col(c) == F.col("__c"), "left").withColumn(c, F.col("__c")).drop("__c")
    return df


def choose_link(train: DataFrame, valid: DataFrame, config: LinearConfig) -> LinearModel:
    """A regression with the label as it is or under log1p, whichever has the smaller error on the label's own scale."""
    models = [LinearModel.fit(train, LinearConfig(**{**config.__dict__, "link": k})) for k in ("identity", "log1p")]
    return min(models, key=lambda m: m.evaluate(valid)["mae"])


def fit_until_worse(train: DataFrame, valid: DataFrame, config: LinearConfig, passes: tuple[int, ...] = (4, 8, 16, 32)) -> LinearModel:
    """Models of growing numbers of passes until the validation score falls."""
    best, score = None, None
    for n in passes:
        m = LinearModel.fit(train, LinearConfig(**{**config.__dict__, "max_iter": n}))
        e = m.evaluate(valid)
        s = (e["auc"] or 0.0) if config.task == "binary" else -e["mse"]
        if score is not None and s <= score:
            break
        best, score = m, s
    return best

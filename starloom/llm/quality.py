"""Quality classification by hierarchical empirical Bayes.

Two logistic classifiers (quality and toxicity) over hashed words, hashed four-byte word beginnings and surface measures are fitted on at most about
``sample_docs`` labelled documents. Every whole text gets its evidence as log odds. Grouped aggregation then gives the mean
quality of each host (source) and of each path under it (source and language): beta priors are fitted by moments over all
hosts, and over all paths around their hosts; a site with little evidence is shrunk to its host, a host to the global prior.
A document's posterior log odds are its own evidence plus the site's log odds against the global ones, times ``site_share``.

Defined results: null and empty texts carry no evidence and are scored by their site alone; null source or lang is a value of
its own; without labels of both kinds a classifier is constant at the known rate (0.5 without any, toxicity 0); repeated
labels count once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Workspace, append_columns, arrow_limits, hash_share, lookup_join
from .kernels import _BASE, U, chunks, mix, normal, words

BITS = 18
_SURFACE = 8
_NULL = "\u0000null"


def _beginnings(texts: list[str | None], offsets: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the first four bytes of each word."""
    from .kernels import _WORD

    buf = np.frombuffer(b" ".join(normal(t) for t in texts) + b"    ", np.uint8)
    inside = np.r_[0, (_WORD[buf] != 0).astype(np.int8), 0]
    starts = np.flatnonzero(np.diff(inside) == 1)
    out = np.zeros(len(starts), U)
    with np.errstate(over="ignore"):
        for k in range(4):
            out = out * _BASE + np.where(length > k, buf[starts + k], 0).astype(U)
    return mix(out ^ U(0x5EED))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed feature) pairs present in each text, and the surface measures."""
    h, at, length = words(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    begin = _beginnings(texts, at, length)
    size = U(1 << BITS)
    pairs = np.unique(np.r_[doc.astype(U) * size + (h >> U(64 - BITS)), doc.astype(U) * size + (begin >> U(64 - BITS))])
    surface = np.zeros((len(texts), _SURFACE))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        if not n[i]:
            continue
        b = np.frombuffer(raw, np.uint8)
        c = np.bincount(b, minlength=256)
        own = h[at[i] : at[i + 1]]
        upper, lower = c[65:91].sum(), c[97:123].sum()
        marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
        surface[i] = [
            1.0, np.log1p(n[i]) / 5, len(np.unique(own)) / n[i], (own[1:] == own[:-1]).mean() if len(own) > 1 else 0.0,
            marks / len(raw), (marks - c[44] - c[46]) / len(raw), upper / max(upper + lower, 1), length[at[i] : at[i + 1]].mean() / 10,
        ]
    return (pairs // size).astype(np.int64), (pairs % size).astype(np.int64), surface


class Classifier:
    """Logistic regression on the presence of selected features (scaled by 1 / sqrt of their number in a text) and surface measures."""

    #: Labelled texts of the rarer class at which its known rate counts half; classes weigh the same when fitting.
    PRIOR_TEXTS = 100

    def __init__(self, weights: np.ndarray | None, rate: float, selected: np.ndarray | None = None, rarer: int = 0):
        self.weights, self.selected, self.constant = weights, selected, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        self.shift = self.constant * self.PRIOR_TEXTS / (self.PRIOR_TEXTS + rarer)

    @classmethod
    def fit(cls, sets: list[np.ndarray], surface: np.ndarray, y: np.ndarray, rounds: int = 100, penalty: float = 1e-4, least_z: float = 3.0, least_texts: int = 7) -> Classifier:
        """Only features are used that least_texts texts have and whose share of positive texts is least_z deviations off the mean."""
        rate = float(y.mean()) if len(y) else 0.5
        if not len(y) or rate in (0.0, 1.0):
            return cls(None, rate)
        d = 1 << BITS
        row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        n, positive = np.bincount(col, minlength=d), np.bincount(col, y[row], d)
        selected = (n >= least_texts) & (np.abs(positive - n * rate) > least_z * np.sqrt(n * rate * (1 - rate)))
        row, col = row[selected[col]], col[selected[col]]
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(sets)), 1))
        w = np.zeros(d + surface.shape[1])
        m, v = np.zeros_like(w), np.zeros_like(w)
        each = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))  # both classes weigh the same
        for t in range(1, rounds + 1):
            z = np.bincount(row, w[col], len(sets)) * scale + surface @ w[d:]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each / len(y)
            grad = np.r_[np.bincount(col, (g * scale)[row], d), surface.T @ g] + penalty * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(w.astype(np.float32), rate, selected, int(min(y.sum(), len(y) - y.sum())))

    def odds(self, row: np.ndarray, col: np.ndarray, surface: np.ndarray) -> np.ndarray:
        """Log odds of each text; zero for texts without words."""
        n = len(surface)
        if self.weights is None:
            return np.full(n, self.constant)
        d = len(self.selected)
        row, col = row[self.selected[col]], col[self.selected[col]]
        z = np.bincount(row, self.weights[col], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + surface[:, : len(self.weights) - d] @ self.weights[d:] + self.shift
        return np.where(surface[:, 0] > 0, np.clip(z, -12, 12), 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000) -> tuple[Classifier, Classifier]:
    """Classifiers of quality and toxicity from at most about sample_docs labelled documents (by a hash of doc_id)."""
    arrow_limits(docs.sparkSession)
    labels = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    few = labels.where(hash_share(["doc_id"], sample_docs, F.lit(labels.count())))
    few = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "quality", "toxic")

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in chunks([len(t or "") for t in texts]):
                row, col, surface = features(texts[lo:hi])
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                sets = [col[x:y].astype(np.uint32).tobytes() for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in surface], pa.binary())], names=["quality", "toxic", "sets", "surface"])

    rows = few.mapInArrow(run, "quality int, toxic int, sets binary, surface binary").toArrow()
    sets = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["sets"].to_pylist()]
    surface = np.array([np.frombuffer(x) for x in rows["surface"].to_pylist()]).reshape(-1, _SURFACE)
    out = []
    for name, empty, measures in (("quality", 0.5, _SURFACE), ("toxic", 0.0, 1)):  # toxicity shows in words alone
        y = rows[name].to_pylist()
        own = [i for i, v in enumerate(y) if v is not None and surface[i, 0] > 0]
        out.append(Classifier.fit([sets[i] for i in own], surface[own, :measures], np.array([float(y[i] > 0) for i in own])) if own else Classifier(None, empty))
    return out[0], out[1]


def evidence(docs: DataFrame, quality: Classifier, toxic: Classifier) -> DataFrame:
    """docs with __quality and __toxic log odds and __words, whether a text has words."""
    shared = docs.sparkSession.sparkContext.broadcast((quality, toxic))
    at = docs.columns.index("text")

    def make() -> Callable:
        def call(b: pa.RecordBatch) -> list:
            texts = [None if x is None else x.decode("utf-8", "replace") for x in b.column(at).cast(pa.binary()).to_pylist()]
            q, t, w = [], [], []
            for lo, hi in chunks([len(x or "") for x in texts]):
                row, col, surface = features(texts[lo:hi])
                q += shared.value[0].odds(row, col, surface).tolist()
                t += shared.value[1].odds(row, col, surface).tolist()
                w += (surface[:, 0] > 0).tolist()
            return [q, t, w]

        return call

    return append_columns(docs, [T.StructField("__quality", T.DoubleType()), T.StructField("__toxic", T.DoubleType()), T.StructField("__words", T.BooleanType())], make)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, center: Column) -> float:
    """Prior observations of a beta distribution around center, by moments over groups (n, s, ss: sums of p and p squared)."""
    p = F.col("s") / F.col("n")
    r = groups.where(F.col("n") >= 2).agg(
        F.sum(F.col("n") * center * (1 - center)).alias("whole"), F.sum(F.col("n") * (p - center) ** 2).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - p**2)).alias("within")
    ).first()
    if not r.n:
        return 10.0
    spread = max(r.between / r.n - r.within / r.n, 1e-6)  # variance between groups beyond the sampling variance
    return float(min(max(r.whole / r.n / spread - 1, 1.0), 10_000.0))


def hierarchical(scored: DataFrame, ws: Workspace, site_share: float = 0.5) -> DataFrame:
    """scored (doc_id, host, path, __quality, __toxic, __words) with host, path and document posteriors."""
    p = _sigmoid(F.col("__quality"))
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(F.col("__words").cast("long")).alias("n"), F.coalesce(F.sum(F.when(F.col("__words"), p)), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(F.col("__words"), p * p)), F.lit(0.0)).alias("ss")]
    paths = ws.table(scored.groupBy("path", "host").agg(*sums), "paths")
    hosts = ws.table(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "s", "ss")), F.count(F.lit(1)).alias("paths")), "hosts")
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    prior = F.lit((whole.s + 0.5) / (whole.n + 1))
    a = _strength(hosts, prior)
    host = hosts.select("host", ((F.col("s") + a * prior) / (F.col("n") + a)).alias("host_posterior"))
    joined = ws.table(lookup_join(paths, host, "host", "inner", sizes=hosts.select("host", F.col("paths").alias("n"))), "sites")
    b = _strength(joined, F.col("host_posterior"))
    site = joined.select("path", "host_posterior", ((F.col("s") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior"))
    n_sites = paths.count()
    if n_sites <= BROADCAST_ROWS:
        out = scored.join(F.broadcast(site), "path", "left")
    else:
        out = lookup_join(scored, site, "path", "left", sizes=paths.select("path", F.col("rows").alias("n")))
    odds = F.when(F.col("__words"), F.col("__quality")).otherwise(F.lit(0.0)) + site_share * (_logit(F.col("path_posterior")) - _logit(prior))
    return out.withColumn("__posterior", F.when(F.col("__words"), _sigmoid(odds)).otherwise(F.col("path_posterior")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, toxic_threshold: float = 0.5) -> DataFrame:
    """(doc_id, doc_score, host_posterior, path_posterior, quality_score, toxic_score, keep): keep if quality is at or over threshold and toxicity under toxic_threshold."""
    ws = Workspace(docs.sparkSession, "quality")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL))
    few = docs.select("doc_id", F.col("text").cast("string").alias("text"), value("source").alias("host"), F.struct(value("source").alias("host"), value("lang").alias("lang")).alias("path"))
    scored = ws.table(evidence(few, *fit(docs, labels)).drop("text"), "scored")
    out = hierarchical(scored, ws)
    toxic = _sigmoid(F.col("__toxic"))
    return out.select("doc_id", _sigmoid(F.col("__quality")).alias("doc_score"), "host_posterior", "path_posterior", F.col("__posterior").alias("quality_score"), toxic.alias("toxic_score"), ((F.col("__posterior") >= threshold) & ((toxic < toxic_threshold) | ~F.col("__words"))).alias("keep"))

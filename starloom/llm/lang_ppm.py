"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ``order``: for every context the counts of the bytes that followed it. A
text's code length under a language is exact: at each byte the longest known context codes the byte, or escapes to the next
shorter one with the escape probability d / (n + d) (n: counts, d: distinct bytes), bytes already tried being excluded; the
last resort is uniform over the bytes never seen. The statistics are frozen after fitting. The language with the shortest
code wins.

Fitting uses at most about ``sample_docs`` whole texts of each language (chosen by a hash of text and id); every text is scored whole.
Every language of the table is learned, with all windows of its texts.

Defined results: ``und`` with score 0 for null texts, texts without letters, and where nothing was learned; ties go to the
smaller language name; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_limits, hash_share
from .kernels import U, chunks

ORDER = 4
_PIECE = 1 << 18


def windows(buf: np.ndarray, order: int) -> np.ndarray:
    """Each byte from the order-th on with the order bytes before it, as one number (the byte itself lowest)."""
    n = len(buf) - order
    out = np.zeros(max(n, 0), U)
    for j in range(order + 1):
        out |= buf[order - j : order - j + n].astype(U) << U(8 * j)
    return out


class ContextTree:
    """One language's frozen context tree, as sorted tables of each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        """keys: windows of order + 1 bytes with their counts; every shorter context follows from them."""
        self.order = order
        self.grams, self.counts, self.contexts, self.n, self.d, self.n_rest, self.d_rest = [], [], [], [], [], [], []
        for k in range(order + 1):
            g = keys & U((1 << 8 * (k + 1)) - 1)
            gram, inverse = np.unique(g, return_inverse=True)
            count = np.bincount(inverse, counts, len(gram))
            context, at = np.unique(gram >> U(8), return_inverse=True)
            n, d = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context)).astype(float)
            if k:  # what is left in the next shorter context for the bytes not seen here
                short = np.searchsorted(self.contexts[k - 1], context & U((1 << 8 * (k - 1)) - 1))
                taken = self.counts[k - 1][np.searchsorted(self.grams[k - 1], gram & U((1 << 8 * k) - 1))]
                self.n_rest.append(self.n[k - 1][short] - np.bincount(at, taken, len(context)))
                self.d_rest.append(self.d[k - 1][short] - d)
            else:
                self.n_rest.append(np.zeros(1))
                self.d_rest.append(np.zeros(1))
            for table, x in ((self.grams, gram), (self.counts, count), (self.contexts, context), (self.n, n), (self.d, d)):
                table.append(x)

    def bits(self, w: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window."""
        cost = np.zeros(len(w))
        todo = np.arange(len(w))
        n_now, d_now = np.full(len(w), -1.0), np.zeros(len(w))  # n_now < 0: no longer context is known
        for k in range(self.order, -1, -1):
            gram = w[todo] & U((1 << 8 * (k + 1)) - 1)
            at, known = _find(self.contexts[k], gram >> U(8))
            at_gram, seen = _find(self.grams[k], gram)
            fresh = n_now[todo] < 0
            n = np.where(fresh, self.n[k][at], n_now[todo])
            d = np.where(fresh, self.d[k][at], d_now[todo])
            whole = np.log2(np.maximum(n + d, 1))
            cost[todo] += np.where(seen, whole - np.log2(np.where(seen, self.counts[k][at_gram], 1)), np.where(known & (d > 0), whole - np.log2(np.maximum(d, 1)), 0))
            n_now[todo] = np.where(known, self.n_rest[k][at], n_now[todo])
            d_now[todo] = np.where(known, self.d_rest[k][at], d_now[todo])
            todo = todo[~seen]
            if not len(todo):
                return cost
        cost[todo] += np.log2(max(256 - len(self.grams[0]), 1))
        return cost


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """The context trees of all languages, with a direct-mapped cache of code lengths in each worker."""

    def __init__(self, trees: dict[str, ContextTree], order: int):
        self.langs, self.trees, self.order = sorted(trees), [trees[x] for x in sorted(trees)], order
        self._keys = None

    def __getstate__(self):
        return {"langs": self.langs, "trees": self.trees, "order": self.order, "_keys": None}

    def _costs(self, w: np.ndarray) -> np.ndarray:
        if self._keys is None:
            self._shift = U(64 - (20 if len(self.langs) <= 8 else min(16, max(8, 24 - len(self.langs).bit_length()))))
            self._keys = np.full(1 << 64 - int(self._shift), np.iinfo(np.uint64).max, U)
            self._values = np.zeros((len(self._keys), len(self.langs)))
        with np.errstate(over="ignore"):
            slot = (w * U(0x9E3779B97F4A7C15)) >> self._shift
        out = self._values[slot]
        miss = np.flatnonzero(self._keys[slot] != w)
        if len(miss):
            new, inverse = np.unique(w[miss], return_inverse=True)
            costs = np.stack([t.bits(new) for t in self.trees], axis=1)
            out[miss] = costs[inverse]
            with np.errstate(over="ignore"):
                to = (new * U(0x9E3779B97F4A7C15)) >> self._shift
            to, first = np.unique(to, return_index=True)
            self._keys[to], self._values[to] = new[first], costs[first]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        pad = b"\n" * self.order
        piece = max(1024, _PIECE * 8 // max(8, len(self.langs)))
        for lo, hi in chunks([len(t) for t in texts]):
            buf = np.frombuffer(b"".join(pad + t for t in texts[lo:hi]), np.uint8)
            starts = np.cumsum([0, *(len(t) + self.order for t in texts[lo:hi])])
            for at in range(0, len(buf) - self.order, piece):
                end = min(at + piece, len(buf) - self.order)
                costs = self._costs(windows(buf[at : end + self.order], self.order))
                total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(costs, axis=0, dtype=np.float64)])
                # row i codes byte at + i + order; a text's own bytes begin order after its start
                a = np.clip(starts[:-1] - at, 0, end - at)
                b = np.clip(starts[1:] - self.order - at, 0, end - at)
                out[lo:hi] += total[np.maximum(a, b)] - total[a]
        return out


def _count(docs: DataFrame, order: int) -> DataFrame:
    """(lang, window, n) of whole texts."""

    def run(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for lo, hi in chunks([len(t) for t in own]):
                    parts = [windows(np.frombuffer(b"\n" * order + t, np.uint8), order) for t in own[lo:hi]]
                    keys, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long")


def fit(docs: DataFrame, order: int = ORDER, sample_docs: int = 1500) -> Model:
    """A model of docs (text, lang, doc_id). sample_docs: texts used of each language."""
    arrow_limits(docs.sparkSession)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("lang", "text", "doc_id")
    few = docs.join(F.broadcast(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))), "lang")
    few = few.where(hash_share(["doc_id", "text"], sample_docs, F.col("rows"))).select("lang", "text")
    rows = _count(few, order).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = rows["lang"].combine_chunks().dictionary_encode()
    at, grams, counts = langs.indices.to_numpy(), rows["gram"].to_numpy().astype(U), rows["n"].to_numpy().astype(float)
    by = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=len(langs.dictionary)))
    trees = {lang: ContextTree(grams[own], counts[own], order) for lang, own in zip(langs.dictionary.to_pylist(), np.split(by, ends[:-1]))}
    return Model(trees, order)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of lang_pred under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make() -> Callable:
        m = shared.value

        def call(b: pa.RecordBatch) -> list:
            column = b.column(at)
            letters = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False).to_pylist()
            names, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            own = [i for i, x in enumerate(letters) if x] if m.langs else []
            if own:
                raw = column.cast(pa.binary())
                bits = m.code_lengths([raw[i].as_py() for i in own])
                best = bits.argmin(axis=1)
                scores[own] = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for i, k in zip(own, best.tolist()):
                    names[i] = m.langs[k]
            return [names, scores]

        return call

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)

"""Benchmark decontamination by greedy string tiling over words.

Shared seeds (``width``-word windows with equal Karp-Rabin hashes) join documents to benchmark items. For each joined pair the
longest common run of words that is unmarked in both is marked as a tile, again and again, until no run of ``width`` words is
left; tiles may come in any order, so reordered passages count. Coverage is the share of the item's words inside tiles; a
document with an item at or over ``threshold`` is contaminated.

The benchmark is read in blocks of at most about ``block_words`` words, one at a time on the driver. A single block is broadcast to
one pass over the documents. With more of them each block has a pass of its own, whose matches (few, without texts) are written
to the shared folder, so that only one broadcast is alive; then they are joined to the documents by a digest of the text.

Defined results: null or empty text has no item, coverage 0; null or wordless items match nothing; an item shorter than
``width`` words needs one run of all its words; of items with equal coverage the smaller item_id is the best; repeated items
count once each; other columns pass through, columns with the new names are replaced.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Workspace, append_columns, fresh, lookup_join
from .kernels import _BASE, U, _powers, chunks, mix, words

FIELDS = [T.StructField("contaminated", T.BooleanType()), T.StructField("best_item", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType())]
ITEMS = to_arrow_schema(T.StructType([FIELDS[3]])).types[0]


def tiles(item: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(position in item, position in text, length) of each tile. i, j: positions of all common windows of width words."""
    diagonal = j - i
    order = np.lexsort((i, diagonal))
    i, j, diagonal = i[order], j[order], diagonal[order]
    new = np.r_[True, (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)]
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(i)]) + width - 1
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), i[begin].tolist(), j[begin].tolist())]
    heapq.heapify(heap)
    in_item, in_text, out = bytearray(len(item)), bytearray(len(text)), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not (in_item[a + k] or in_text[b + k]) for k in range(n)]
        if all(free):
            in_item[a : a + n] = in_text[b : b + n] = b"\1" * n
            out.append((a, b, n))
            continue
        k = 0
        while k < n:  # the unmarked rest is tried again at its own length
            if not free[k]:
                k += 1
                continue
            e = k
            while e < n and free[e]:
                e += 1
            if e - k >= width:
                heapq.heappush(heap, (k - e, a + k, b + k))
            k = e
    return out


def runs(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(running Karp-Rabin hash of each run of width words, offsets of each text's runs): differences of one running sum."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    offsets = np.r_[0, np.cumsum(n)].astype(np.int64)
    begin = np.repeat(at[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    power, inverse = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(h * power[: len(h)], out=total[1:])
        return mix((total[begin + width] - total[begin]) * inverse[begin] * _BASE), offsets


class Seeds:
    """The windows of a block of benchmark items, by width."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, threshold: float):
        self.threshold = threshold
        h, at, _ = words([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(at[:-1], at[1:])]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in sorted({min(width, len(x)) for x in self.words if len(x)}):
            own = [k for k, x in enumerate(self.words) if len(x) and min(width, len(x)) == w]
            flat, offsets = np.concatenate([self.words[k] for k in own]), np.r_[0, np.cumsum([len(self.words[k]) for k in own])]
            keys, at_ = runs(flat, offsets, w)
            n = np.diff(at_)
            owner, spot = np.repeat(own, n), np.arange(len(keys)) - np.repeat(at_[:-1], n)
            order = np.argsort(keys, kind="stable")
            self.by_width[w] = (keys[order], owner[order], spot[order])

    def matches(self, texts: list[str | None]) -> tuple[list[list[tuple[int, float]]], np.ndarray]:
        """(item number, coverage) of each text's items that may reach the threshold, and the texts' word counts."""
        h, at, _ = words(texts)
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        for w, (keys, owner, spot) in self.by_width.items():
            mine, offsets = runs(h, at, w)
            left = np.searchsorted(keys, mine)
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == mine)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            for d in np.unique(doc).tolist():
                text = h[at[d] : at[d + 1]]
                j = hit[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")] - offsets[d]
                out[d] += self._covered(text, j, mine[offsets[d] + j], w, keys, owner, spot)
        return out, np.diff(at)

    def _covered(self, text: np.ndarray, j: np.ndarray, mine: np.ndarray, w: int, keys: np.ndarray, owner: np.ndarray, spot: np.ndarray) -> list[tuple[int, float]]:
        """Coverage of the items that share windows with one text (at positions j, with hashes mine)."""
        seeds = np.unique(mine)
        first, last = np.searchsorted(keys, seeds), np.searchsorted(keys, seeds, side="right")
        which = np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first) + np.arange((last - first).sum())  # each seed of the block once at most
        item, i = owner[which], spot[which]
        order = np.lexsort((i, item))
        item, i, seed = item[order], i[order], keys[which][order]
        out = []
        by = np.argsort(mine, kind="stable")
        for part in np.split(np.arange(len(item)), np.flatnonzero(item[1:] != item[:-1]) + 1):
            p = self.words[int(item[part[0]])]
            seen = np.zeros(len(p) + 1, np.int64)  # no tiling covers more than the seeds do
            np.add.at(seen, i[part], 1)
            np.add.at(seen, i[part] + w, -1)
            if (np.cumsum(seen)[:-1] > 0).mean() < self.threshold:
                continue
            a, b = np.searchsorted(mine[by], seed[part]), np.searchsorted(mine[by], seed[part], side="right")
            spots = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
            pi, tj = np.repeat(i[part], b - a), j[by[spots]]
            same = np.ones(len(pi), bool)  # equal hashes are compared word by word
            for k in range(w):
                same &= p[pi + k] == text[tj + k]
            if same.any():
                found = tiles(p, text, pi[same], tj[same], w)
                out.append((int(item[part[0]]), sum(n for _, _, n in found) / len(p)))
        return out


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, each once, in blocks of about block_words words by a hash of their text; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    n = max(1, -(-total // block_words))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows or n == 1:
            yield sorted((r.item_id, r.text) for r in rows)


def _one_block(docs: DataFrame, block: list[tuple[int, str]], width: int, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(block, width, threshold))
    at = [c.lower() for c in docs.columns].index("text")

    def make():
        def call(b: pa.RecordBatch) -> list:
            seeds = shared.value
            texts = [None if x is None else x.decode("utf-8", "replace") for x in b.column(at).cast(pa.binary()).to_pylist()]
            best, coverage, items, n_words = [], [], [], []
            for lo, hi in chunks([len(t or "") for t in texts]):
                found, n = seeds.matches(texts[lo:hi])
                n_words += n.tolist()
                for row in found:
                    over = sorted((-c, seeds.ids[i]) for i, c in row if c >= seeds.threshold)
                    best.append(over[0][1] if over else None)
                    coverage.append(-over[0][0] if over else 0.0)
                    items.append(sorted({i for _, i in over}))
            return [[x > 0 for x in coverage], pa.array(best, pa.int64()), coverage, pa.array(items, ITEMS), n_words]

        return call

    return append_columns(docs, FIELDS, make)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """docs with contaminated, best_item, coverage (of the best item at or over the threshold, else 0), items (all such items) and n_words."""
    cut = blocks(benchmark, block_words)
    first, second = next(cut), next(cut, None)
    if second is None:
        return _one_block(docs, first, width, threshold)
    ws = Workspace(docs.sparkSession, "decontam")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    few = docs.select(F.col("text").cast("string").alias("text"))
    found = []
    for k, block in enumerate(itertools.chain([first, second], cut)):
        hits = _one_block(few, block, width, threshold).where("contaminated")
        found.append(ws.table(hits.select(digest.alias("digest"), "best_item", "coverage", "items").distinct(), f"block-{k}"))
    every = functools.reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("coverage", (-F.col("best_item")).alias("least")))
    every = every.groupBy("digest").agg(best.alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = ws.table(every.select("digest", (-F.col("best.least")).alias("best_item"), F.col("best.coverage").alias("coverage"), "items"), "found")
    plain = _one_block(docs, [], width, threshold)  # the word counts, and columns without any match
    names = plain.columns
    key, *new = (fresh(names, c) for c in ("digest_", "best_", "coverage_", "items_"))
    every = every.select(F.col("digest").alias(key), *(F.col(c).alias(n) for c, n in zip(("best_item", "coverage", "items"), new)))
    out = lookup_join(plain.withColumn(key, digest), every, key, "left")
    value = {"contaminated": F.col(new[1]).isNotNull(), "best_item": F.col(new[0]), "coverage": F.coalesce(F.col(new[1]), F.lit(0.0)), "items": F.coalesce(F.col(new[2]), F.col("items"))}
    return out.select(*(value[c].alias(c) if c in value else F.col(f"`{c}`") for c in names))

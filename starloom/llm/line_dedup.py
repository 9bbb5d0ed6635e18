"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys under ``min_chars`` code
points are never counted. A key found in at least two documents is *shared*; its lines stay only in the smallest doc_id.

State (all in shared storage, none on the driver):
  postings  (doc_id, key, slot): one row for each document and distinct key in it
  refs      (key, slot, n, first, last): exact reference count, smallest and largest doc_id
  filters   (shard, n_keys, blob): a cuckoo filter of the shared keys of each shard
A shard's filter answers "may this key be shared?"; only such postings reach the exact table. Inserting documents adds the
keys whose count passes from one document to two; deleting documents takes out those that fall back, and the next smallest
document gets its lines again.

Defined results: null or empty text is one empty line; rows with the same doc_id are one document; a null doc_id is one
document that sorts after all others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, Workspace, append_columns, arrow_limits, fresh
from .kernels import U, mix

_STRIP = b" \t\n\x0b\x0c\r"
_LAST_ID = (1 << 63) - 1


class CuckooFilter:
    """Approximate set of 64-bit hashes: 16-bit fingerprints in buckets of four, with deletion."""

    WIDTH = 4

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None, stash: list[int] | None = None):
        if table is None:
            buckets = 1 << max(3, int(np.ceil(np.log2(max(capacity, 1) / (self.WIDTH * 0.8)))))
            table = np.zeros((buckets, self.WIDTH), np.uint16)
        self.table = table
        self.stash = set(stash or ())  # hashes that found no place; looked up exactly

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = U(len(self.table) - 1)
        print_ = (h >> U(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = h & mask
        two = (one ^ mix(print_.astype(U))) & mask
        return print_, one.astype(np.int64), two.astype(np.int64)

    def insert(self, hashes: np.ndarray, kicks: int = 500) -> None:
        h = np.asarray(hashes, U)
        if not len(h):
            return
        prints, one, two = self._places(h)
        left = np.arange(len(h))
        for spots in (one, two):  # whole buckets at once, then one by one
            order = left[np.argsort(spots[left], kind="stable")]
            b = spots[order]
            begin = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            rank = np.arange(len(b)) - np.repeat(begin, np.diff(np.r_[begin, len(b)]))
            free = np.argsort(self.table[b] != 0, axis=1, kind="stable")
            room = (self.table[b] == 0).sum(axis=1)
            fits = rank < room
            self.table[b[fits], free[fits, rank[fits]]] = prints[order[fits]]
            left = order[~fits]
            if not len(left):
                return
        rng = np.random.default_rng(1)
        for i in left.tolist():
            f, b, placed = prints[i], int(one[i]), False
            trail = []
            for _ in range(kicks):
                zero = np.flatnonzero(self.table[b] == 0)
                if len(zero):
                    self.table[b, zero[0]] = f
                    placed = True
                    break
                k = int(rng.integers(self.WIDTH))
                out = self.table[b, k]
                trail.append((b, k, out))
                self.table[b, k] = f
                f = out
                b = int((U(b) ^ mix(np.array([f], U))[0]) & U(len(self.table) - 1))
            if not placed:
                for b, k, f in reversed(trail):  # put everything back; the key goes to the stash
                    self.table[b, k] = f
                self.stash.add(int(h[i]))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        h = np.asarray(hashes, U)
        prints, one, two = self._places(h)
        found = (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)
        if self.stash:
            found |= np.isin(h, np.array(sorted(self.stash), U))
        return found

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out hashes that were inserted before."""
        h = np.asarray(hashes, U)
        prints, one, two = self._places(h)
        for x, f, *spots in zip(h.tolist(), prints, one, two):
            if x in self.stash:
                self.stash.remove(x)
                continue
            for b in spots:
                k = np.flatnonzero(self.table[b] == f)
                if len(k):
                    self.table[b, k[0]] = 0
                    break

    def dump(self) -> bytes:
        return np.array([len(self.stash)], U).tobytes() + np.array(sorted(self.stash), U).tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        n = int(np.frombuffer(blob[:8], U)[0])
        stash = np.frombuffer(blob[8 : 8 + 8 * n], U).tolist()
        return cls(table=np.frombuffer(blob[8 + 8 * n :], np.uint16).reshape(-1, cls.WIDTH).copy(), stash=stash)


def key_of(line: bytes, min_chars: int = 10) -> bytes | None:
    """The 128-bit digest of a line's key; None for a short one."""
    k = line.strip(_STRIP).lower()  # bytes.lower() is A-Z only
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(k, digest_size=16).digest()


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _hashes(keys: pa.Array) -> np.ndarray:
    """The last eight bytes of each key; its shard comes from the first four."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), U)
    return raw[1::2]


def doc_order(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(_LAST_ID))


_POSTING = "doc_id long, key binary, slot int"


def postings(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, key, slot) of each document and distinct key in it."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                own = {k for x in t.split(b"\n") if (k := key_of(x, min_chars))}
                ids += [d] * len(own)
                keys += own
            slots = (np.frombuffer(b"".join(keys), np.uint32)[::4] >> 1).astype(np.int32) if keys else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(slots)], names=["doc_id", "key", "slot"])

    return docs.select(doc_order(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _POSTING)


def _counted(posts: DataFrame) -> DataFrame:
    return posts.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


class LineIndex:
    """Postings, reference counts and filters of the documents inserted so far."""

    def __init__(self, docs: DataFrame, min_chars: int = 10, shard_rows: int = 200_000):
        """shard_rows: postings a shard should hold; it sets the number of shards, 64 at least, anew whenever the shared keys have doubled."""
        self.ws, self.min_chars = Workspace(docs.sparkSession, "line-index"), min_chars
        self.version = 0
        self.postings = self.ws.table(postings(docs, min_chars), "postings-0")
        self.refs = self.ws.table(_counted(self.postings), "refs-0")
        self.shard_rows = shard_rows
        self._size()
        self._rebuild("filters-0")

    def _size(self) -> None:
        shared = F.coalesce(F.sum((F.col("first") < F.col("last")).cast("long")), F.lit(0))
        self.total, self.n_shared = self.refs.agg(F.coalesce(F.sum("n"), F.lit(0)), shared).first()

    def _rebuild(self, name: str) -> None:
        """All filters anew, each with room for twice its keys."""
        self.shards, self.built = max(64, -(-self.total // self.shard_rows)), self.n_shared
        self.filters = self.ws.table(self._build(self._shared(self.refs)), name)

    @staticmethod
    def _shared(refs: DataFrame) -> DataFrame:
        return refs.where(F.col("first") < F.col("last"))

    def _shard(self, slot: str = "slot") -> Column:
        return (F.col(slot) % F.lit(self.shards)).alias("shard")

    def _build(self, shared: DataFrame) -> DataFrame:
        def build(t: pa.Table) -> pa.Table:
            h = _hashes(t["key"].combine_chunks())
            f = CuckooFilter(2 * len(h))
            f.insert(h)
            return pa.table({"shard": t["shard"][:1], "n_keys": pa.array([len(h)], pa.int64()), "blob": pa.array([f.dump()], pa.binary())})

        return shared.select(self._shard(), "key").groupBy("shard").applyInArrow(build, "shard int, n_keys long, blob binary")

    def candidates(self, posts: DataFrame) -> DataFrame:
        """Those postings whose key may be shared, by their shard's filter."""

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            out = left.select(["doc_id", "key"])
            if not right.num_rows or not left.num_rows:
                return out.slice(0, 0)
            return out.filter(pa.array(CuckooFilter.load(right["blob"][0].as_py()).contains(_hashes(left["key"].combine_chunks()))))

        a = posts.select(self._shard(), "doc_id", "key").groupBy("shard")
        return a.cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "doc_id long, key binary")

    def losing(self, posts: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys): the keys of each document whose lines it loses. Very frequent keys are looked up on the map side."""
        posts = self.postings if posts is None else posts
        many = max(1, int(self.total * HOT_SHARE))  # at most 1 / HOT_SHARE keys are over it
        shared = self._shared(self.refs).select("key", "first", "n")
        hot = F.broadcast(shared.where(F.col("n") > many).select("key", "first"))
        with_hot = posts.join(hot, "key", "left")
        sure = with_hot.where(F.col("first") < F.col("doc_id")).select("doc_id", "key")
        rest = self.candidates(with_hot.where(F.col("first").isNull()).select("doc_id", "key", "slot"))
        rest = rest.join(shared.where(F.col("n") <= many).select("key", "first"), "key").where(F.col("first") < F.col("doc_id")).select("doc_id", "key")
        return sure.unionByName(rest).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def insert(self, docs: DataFrame) -> None:
        """Adds documents with new ids; raises ValueError if lines of one of the ids are known already."""
        added = self.ws.table(postings(docs, self.min_chars), f"added-{self.version}")
        if self.postings.join(added.select("doc_id").distinct(), "doc_id", "left_semi").limit(1).count():
            raise ValueError("documents with these ids were inserted before; delete them first")
        self._merge(added, None)
        self.ws.drop(f"added-{self.version - 1}")

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes out the documents of the ids in the first column."""
        ids = doc_ids.select(doc_order(F.col(doc_ids.columns[0])).alias("doc_id")).distinct()
        self._merge(None, ids)

    def _merge(self, added: DataFrame | None, gone: DataFrame | None) -> None:
        v, old = self.version + 1, self.version
        posts = self.postings.join(gone, "doc_id", "left_anti") if gone is not None else self.postings.unionByName(added)
        posts = self.ws.table(posts, f"postings-{v}")
        changed = (self.postings.join(gone, "doc_id", "left_semi") if gone is not None else added).select("key").distinct()
        kept = self.refs.join(changed, "key", "left_anti")
        refs = self.ws.table(kept.unionByName(_counted(posts.join(changed, "key", "left_semi"))), f"refs-{v}")
        was, now = self._shared(self.refs).select("key", "slot"), self._shared(refs).select("key", "slot")
        moved = now.join(was, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, "key", "left_anti").withColumn("add", F.lit(False)))

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            h, add = _hashes(left["key"].combine_chunks()), np.array(left["add"].to_pylist(), bool)
            n = right["n_keys"][0].as_py() if right.num_rows else 0
            f = CuckooFilter.load(right["blob"][0].as_py()) if right.num_rows else CuckooFilter(2 * len(h))
            f.delete(h[~add])
            n += int(add.sum()) - int((~add).sum())
            f.insert(h[add])  # what finds no place goes to the exact stash
            shard = (left if left.num_rows else right)["shard"][:1]
            return pa.table({"shard": shard, "n_keys": pa.array([n], pa.int64()), "blob": pa.array([f.dump()], pa.binary())})

        a = moved.select(self._shard(), "key", "add").groupBy("shard").cogroup(self.filters.groupBy("shard"))
        updated = a.applyInArrow(update, "shard int, n_keys long, blob binary")
        self.postings, self.refs, self.version = posts, refs, v
        self._size()
        if self.n_shared > 2 * max(self.built, self.shards):
            self._rebuild(f"filters-{v}")
        else:
            self.filters = self.ws.table(updated, f"filters-{v}")
        for name in ("postings", "refs", "filters"):
            self.ws.drop(f"{name}-{old}")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = 10) -> DataFrame:
    """docs with kept_text, n_lines (before dropping) and n_dropped."""
    index = index or LineIndex(docs, min_chars)
    names = docs.columns
    order, lost_id, lost_keys = (fresh(names, x) for x in ("order", "lost_id", "lost_keys"))
    lost = index.losing().select(F.col("doc_id").alias(lost_id), F.col("keys").alias(lost_keys))
    joined = docs.withColumn(order, doc_order(F.col("doc_id"))).join(lost, F.col(order) == F.col(lost_id), "left")
    at, keys_at = names.index("text"), len(names)

    def make():
        def call(b: pa.RecordBatch) -> list:
            kept, n_lines, n_dropped = [], [], []
            for t, keys in zip(_texts(b.column(at)), b.column(keys_at).to_pylist()):
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    lines = [x for x in lines if key_of(x, min_chars) not in gone]
                kept.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

        return call

    fields = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return append_columns(joined.select(*names, lost_keys), fields, make).drop(lost_keys)

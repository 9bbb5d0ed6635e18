"""Similarity join on word shingles with a MinHash LSH forest and exact verification.

Each distinct set of five-word shingles gets ``TREES`` paths of ``DEPTH`` MinHash bytes; the sorted paths of a tree are its prefix
trie. Two sets of Jaccard similarity s share a prefix of x bytes in at least one tree with probability 1 - (1 - s^x)^TREES. The
shortest prefix that may be needed (the longest with the target recall at the threshold) gives subtries; inside each of them,
sorted by the rest of the path, the matched prefix starts at the full depth and is shortened byte by byte until all sets of
the subtrie are joined or the target recall is reached. Two sets that match are a candidate pair if the bytes after the shortest
prefix (of all trees) agree as often as those of similar sets do but for one pair in 10^4 or so; pairs that only chance or a
common frame brought together do not join anything. Subtries of over ``NODE_ROWS`` sets are joined whole.

The components of the candidate pairs are verified exactly, every pair inside of them (so links that no tree showed are found
there too), in tiles of bounded size; a tile emits the number of links of each document and one link to its smallest connected
document, never its pairs. Classes are the components of verified links only.

Results: class_id is the smallest doc_id of the document's group (connected by links), rep_id the smallest with the same
shingle set, n_links the number of other rows with similarity at or over the threshold (copies included).

Defined results: null, empty and blank texts have no links and are classes of their own; other texts without words are linked to equal texts only; texts of
fewer than five words have one shingle of all their words; rows of one doc_id count as copies of each other; a null doc_id is
the smallest. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_limits, lookup_join
from .components import components
from .kernels import U, chunks, mix, shingles

TREES, DEPTH = 32, 10
#: Sets, and shingles of sets, on each side of a tile; one set alone may have more.
TILE, TILE_SHINGLES = 1024, 2 << 20
#: Sets of a subtrie that are compared with each other.
NODE_ROWS = 4096
_NULL_ID = -(1 << 63)


def recall(similarity: float, prefix: int, trees: int = TREES) -> float:
    return 1 - (1 - similarity**prefix) ** trees


def prefix_for(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest matched prefix with the target recall at the threshold; 1 where none has it."""
    x = depth
    while x > 1 and recall(threshold, x, trees) < target:
        x -= 1
    return x


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U))
    return (seeds[:n] >> U(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> U(32)).astype(np.uint32)


def paths(h: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> bytes:
    """The MinHash bytes of a shingle set, tree by tree."""
    a, b = _constants(trees * depth)
    x = (h >> U(32)).astype(np.uint32)
    least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 512):
            v = np.multiply.outer(a, x[i : i + 512])
            v += b[:, None]
            np.minimum(least, v.min(axis=1), out=least)
    return (mix(least.astype(U)) & U(255)).astype(np.uint8).tobytes()


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    for lo, hi in chunks([len(t or "") for t in texts]):
        h, at = shingles(texts[lo:hi], width)
        out += [np.unique(h[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def _strings(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _signed(docs: DataFrame, width: int, x: int) -> DataFrame:
    """(doc_id, digest, size, heads, tails, mark): the first x bytes of each path, and the others."""

    def run(batches):
        for b in batches:
            texts = _strings(b.column(1))
            digests, sizes, heads, tails = [], [], [], []
            for t, s in zip(texts, shingle_sets(texts, width)):
                sizes.append(len(s))
                if len(s):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    path = np.frombuffer(paths(s), np.uint8).reshape(TREES, DEPTH)
                    heads.append(path[:, :x].tobytes())
                    tails.append(path[:, x:].tobytes())
                else:
                    bare = (t or "").strip()
                    digests.append(hashlib.blake2b(b"\0" + bare.encode("utf-8", "replace"), digest_size=16).digest() if bare else None)
                    heads.append(None)
                    tails.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), b.column(2)], names=["doc_id", "digest", "size", "heads", "tails", "mark"])

    return docs.mapInArrow(run, "doc_id long, digest binary, size int, heads binary, tails binary, mark long")


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes i and j of one component; root: the smallest row of each row's component."""
    while len(i):
        a, b = root[i], root[j]
        off = a != b
        i, j, a, b = i[off], j[off], a[off], b[off]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def joined(node: np.ndarray, tree: np.ndarray, tails: np.ndarray, least: float) -> np.ndarray:
    """The first row of each row's component in whole subtries, sorted by node and own tail. tails: (rows, TREES, bytes)."""
    n, rest = len(node), tails.shape[2]
    own, sketch = tails[np.arange(n), tree], tails.reshape(n, -1)
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[begin, n])
    end, trie = np.repeat(begin + sizes, sizes), np.repeat(np.arange(len(begin)), sizes)
    root, open_ = np.arange(n), sizes > 1
    for depth in range(rest, -1, -1):
        rows, k = np.flatnonzero(open_[trie]), 1
        while len(rows):
            rows = rows[rows + k < end[rows]]
            a = rows[root[rows] != root[rows + k]]
            a = a[(own[a, :depth] == own[a + k, :depth]).all(axis=1)]
            if depth < rest:  # longer matches were tried before
                a = a[own[a, depth] != own[a + k, depth]]
            a = a[(sketch[a] == sketch[a + k]).sum(axis=1) >= least * sketch.shape[1]]
            _join(root, a, a + k)
            k += 1
        open_ &= np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
        if not open_.any():
            break
    return root


def _edges(threshold: float, rest: int):
    """(u, v) for each set of sorted subtries and the first one it is joined to."""
    bytes_ = max(1, TREES * rest)
    least = threshold - 4.3 * (threshold * (1 - threshold) / bytes_) ** 0.5 if rest else 0.0

    def run(batches):
        kept: list[np.ndarray] = []

        def done(node, tree, key, tails):
            root = joined(node, tree, tails.reshape(len(node), TREES, rest), least)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(key[root[own]])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            tails = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, TREES * rest)
            now = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), tails]
            now = [np.concatenate(x) for x in zip(kept, now)] if kept else now
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last subtrie may go on in the next batch
            if last:
                yield done(*(x[:last] for x in now))
            kept = [x[last:] for x in now]
        if kept:
            yield done(*kept)

    return run


def _verify(threshold: float):
    def tile(t: pa.Table) -> pa.Table:
        """Links between the two sides of a tile (side 0 and 1), or within side 2; clusters do not mix."""
        docs, side, copies = (t[c].to_numpy() for c in ("doc_id", "side", "copies"))
        salt = mix(t["cluster"].to_numpy().astype(np.int64).view(U))
        sets = [np.frombuffer(x, U) for x in t["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        keys = np.concatenate(sets) ^ salt[owner]
        order = np.argsort(keys, kind="stable")
        keys, owner_sorted = keys[order], owner[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.r_[begin, len(keys)])
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), length)  # which posting list each shingle of each set has
        at = np.r_[0, np.cumsum(size)]
        links, root = np.zeros(len(docs), np.int64), np.arange(len(docs))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in np.flatnonzero(side != 1).tolist():
            g = group[at[i] : at[i + 1]]
            g = g[length[g] > 1]
            if not len(g):
                continue
            n = length[g]
            spots = np.repeat(begin[g] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            common = np.bincount(owner_sorted[spots], minlength=len(docs))
            if side[i] == 0:
                common[side != 1] = 0
            else:
                common[: i + 1] = 0  # each pair once
            j = np.flatnonzero(common)
            # the same comparison as common / union >= threshold, in whole thousandths
            j = j[common[j] * 1000 >= int(round(threshold * 1000)) * (size[i] + size[j] - common[j])]
            if not len(j):
                continue
            links[i] += copies[j].sum()
            links[j] += copies[i]
            for k in j.tolist():
                a, b = find(i), find(k)
                if a != b:
                    a, b = (a, b) if docs[a] < docs[b] else (b, a)
                    root[b] = a
        found = np.flatnonzero(links)
        peers = docs[[find(i) for i in found.tolist()]] if len(found) else np.empty(0, np.int64)
        return pa.table({"doc_id": pa.array(docs[found], pa.int64()), "links": pa.array(links[found], pa.int64()), "peer": pa.array(peers, pa.int64())})

    return tile


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, target: float = 0.999) -> DataFrame:
    """(doc_id, class_id, rep_id, n_links, n_shingles, group_key, mark), one row for each row of docs.

    group_key tells groups apart that have one class_id (where one doc_id stands on several texts) and is null for texts that have
    no links by rule; mark is a hash of the text.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    ws = Workspace(spark, "lsh-forest")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a text is known by its doc_id and mark, a set of shingles by a key from its digest: one doc_id may stand on several texts
    docs = docs.withColumn("mark", F.xxhash64("text"))
    x = prefix_for(threshold, target)
    signed = ws.table(_signed(docs, width, x), "signed")
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"))
    classes = ws.table(classes.select("digest", F.xxhash64("digest").alias("key"), F.col("first.doc_id").alias("rep_id"), F.col("first.mark").alias("rep_mark"), "copies", "size"), "classes")
    reps = signed.where(F.col("size") > 0).join(classes.select("digest", "key", F.col("rep_id").alias("doc_id"), F.col("rep_mark").alias("mark")), ["doc_id", "digest", "mark"]).dropDuplicates(["key"])
    reps = ws.table(reps.select("key", "heads", "tails"), "reps")

    head = lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.expr("heads").substr(t * x + 1, F.lit(x))).alias("node"))
    nodes = reps.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), head)).alias("at")).select("key", "at.tree", "at.node")
    nodes = ws.table(nodes, "nodes")
    heads = ws.table(nodes.groupBy("node").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "heads")
    members = lookup_join(nodes, heads.select("node", "head", F.col("n").alias("sets")), "node", "inner", sizes=heads.select("node", "n"))
    whole = members.where(F.col("sets") > NODE_ROWS).select(F.col("key").alias("u"), F.col("head").alias("v"))
    small = members.where(F.col("sets") <= NODE_ROWS).join(reps.select("key", "tails"), "key")
    own = F.expr("tails").substr(F.col("tree") * (DEPTH - x) + 1, F.lit(DEPTH - x))
    small = small.select("node", "tree", "key", "tails", own.alias("own")).repartition("node").sortWithinPartitions("node", "own", "key")
    pairs = small.select("node", "tree", "key", "tails").mapInArrow(_edges(threshold, DEPTH - x), "u long, v long")
    clusters = components(whole.unionByName(pairs), ws, "candidates")
    for name in ("reps", "nodes", "heads"):
        ws.drop(name)

    members = clusters.select(F.col("u").alias("key"), F.col("v").alias("cluster"))
    members = members.unionByName(members.select(F.col("cluster").alias("key"), "cluster").distinct())
    members = ws.table(members.join(classes.select("key", F.col("rep_id").alias("doc_id"), F.col("rep_mark").alias("mark"), "copies", "size"), "key"), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    total = members.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    packs = 1 + max(total.m // TILE, total.s // TILE_SHINGLES)
    # large clusters are cut into blocks, each pair of blocks a tile; small ones are packed many to a tile
    sized = lookup_join(members, sizes, "cluster", "inner", sizes=sizes.select("cluster", F.col("m").alias("n")))
    blocks = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("s") / TILE_SHINGLES)).cast("int")
    sized = sized.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))

    def pack(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([compress(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary()), b.column(2)], names=["doc_id", "z", "mark"])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            sets = shingle_sets([unpack(z).decode("utf-8", "replace") for z in b.column(1).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), b.column(5), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "cluster", "copies", "nb", "block", "shingles"])

    texts = docs.mapInArrow(pack, "doc_id long, z binary, mark long").join(sized.select("key", "doc_id", "mark", "cluster", "copies", "nb", "block"), ["doc_id", "mark"]).dropDuplicates(["key"])
    sets = texts.select("key", "z", "cluster", "copies", "nb", "block").mapInArrow(run, "key long, cluster long, copies long, nb int, block int, shingles binary")
    own = F.col("block")
    spread = F.when(F.col("nb") == 1, F.array(F.struct(F.pmod(F.xxhash64("cluster"), F.lit(packs)).alias("a"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(2).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("nb") - 1),
            lambda o: F.struct(F.col("cluster").alias("a"), F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), F.when(own == o, 2).when(own < o, 0).otherwise(1).alias("side")),
        )
    )
    tiles = sets.withColumn("t", F.explode(spread)).select(F.col("key").alias("doc_id"), "cluster", "copies", "shingles", "t.a", "t.lo", "t.hi", "t.side")
    links = ws.table(tiles.groupBy("a", "lo", "hi").applyInArrow(_verify(threshold), "doc_id long, links long, peer long"), "links")
    ws.drop("members")
    groups = components(links.select(F.col("doc_id").alias("u"), F.col("peer").alias("v")), ws, "groups")
    counts = links.groupBy("doc_id").agg(F.sum("links").alias("links"))

    paired = groups.select(F.col("u").alias("key"), F.col("v").alias("group"))
    paired = paired.unionByName(paired.select(F.col("group").alias("key"), "group")).distinct()
    paired = ws.table(paired.join(classes.select("key", "rep_id"), "key"), "paired")
    lows = paired.groupBy("group").agg(F.min("rep_id").alias("low"), F.count(F.lit(1)).alias("n"))
    paired = lookup_join(paired.select("key", "group"), lows.select("group", "low"), "group", "inner", sizes=lows.select("group", "n")).select("key", "low", "group")
    table = classes.join(counts.withColumnRenamed("doc_id", "key"), "key", "left").join(paired, "key", "left")
    table = table.select("digest", F.coalesce("low", "rep_id").alias("class_id"), "rep_id", F.coalesce("group", "key").alias("group_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = lookup_join(signed.select("doc_id", "digest", "size", "mark"), table, "digest", "left", sizes=classes.select("digest", F.col("copies").alias("n")))
    null = lambda c: F.when(c != F.lit(_NULL_ID), c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), null(F.coalesce("class_id", "doc_id")).alias("class_id"), null(F.coalesce("rep_id", "doc_id")).alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("size").cast("long").alias("n_shingles"), "group_key", "mark")

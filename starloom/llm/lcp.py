"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed level by level. On each level runs of one symbol become one symbol; deterministic coin tossing
(lowest differing bit against the left neighbour, repeated) reduces the symbols to three labels without equal neighbours; a
phrase starts at each local maximum of the labels, so it has two to a few symbols; its name is a hash of their names. Where a
phrase starts depends on a bounded neighbourhood only, so equal substrings get equal phrases in their interior whatever
stands before them. The fingerprint is the k smallest 32-bit names of the phrases of ``LEVELS`` (about 20 and 50 bytes), in hex.

Defined results: null text counts as empty and has an empty fingerprint; two empty texts have likeness 1, an empty and another
one 0; a table of one document is its own next document; a null doc_id sorts first; rows with equal doc_id stand in the order
of their compressed texts; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, count_rows, stored_bytes
from .kernels import U, chunks, mix

LEVELS = (3, 4)
K = 64
#: Stored bytes of documents that one bucket should hold; buckets are streamed, so this bounds a task's time, not its memory.
BUCKET_BYTES = 1 << 30
_STEP = U(0xC2B2AE3D27D4EB4F)

_CTZ8 = np.array([0, *((x & -x).bit_length() - 1 for x in range(1, 256))], np.uint8)
_LEAST = np.array([next(v for v in range(4) if not m >> v & 1) for m in range(8)], np.uint8)


def _toss(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest bit that differs from the left neighbour) + that bit; a first symbol counts as differing in bit 0."""
    x = np.empty_like(a)
    x[1:] = a[1:] ^ a[:-1]
    x[first] = 1
    if a.dtype == np.uint8:
        p = _CTZ8[x]
        return (p << 1) | ((a >> p) & 1)
    low = x & (~x + U(1))
    p = (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint8)
    return (p << 1) | ((a >> p.astype(U)) & U(1)).astype(np.uint8)


def _labels(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0, 1 and 2 without equal neighbours, for symbols without equal neighbours."""
    lab = _toss(a, first)
    for _ in range(3 if a.dtype != np.uint8 else 2):
        lab = _toss(lab, first)
    bit = np.left_shift(np.uint8(1), lab)
    for v in (3, 4, 5):
        i = np.flatnonzero(lab == v)
        if not len(i):
            continue
        left = np.where(first[i], 0, bit[i - 1])
        j = np.minimum(i + 1, len(lab) - 1)
        right = np.where((j == i) | first[j], 0, bit[j])
        lab[i] = _LEAST[(left | right) & 7]
        bit[i] = np.left_shift(np.uint8(1), lab[i])
    return lab


def _level(a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the next level and which of them begin a text."""
    new = np.empty(len(a), bool)
    new[0] = True
    np.not_equal(a[1:], a[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    run = np.diff(np.r_[at, len(a)])
    base, first = a[at], first[at]
    lab = _labels(base, first)
    name = mix(base.astype(U) + U(1)) if base.dtype == np.uint8 else base
    long = run > 1
    with np.errstate(over="ignore"):
        name[long] = mix(name[long] + run[long].astype(U) * _STEP)
    top = np.zeros(len(lab), bool)
    if len(lab) > 2:
        top[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:]) & ~first[2:]
    top |= first
    s = np.flatnonzero(top)
    e = np.r_[s[1:], len(lab)]
    out = mix(name[s])
    k = 1
    while True:
        more = np.flatnonzero(s + k < e)
        if not len(more):
            break
        with np.errstate(over="ignore"):
            out[more] = mix(out[more] * _STEP + name[s[more] + k])
        k += 1
    return out, first[s]


def parse(texts: list[bytes], levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, name) of each phrase on the given levels."""
    lengths = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return np.empty(0, np.int64), np.empty(0, U)
    a = np.frombuffer(b"".join(texts), np.uint8)
    first = np.zeros(len(a), bool)
    first[np.r_[0, np.cumsum(lengths[full])[:-1]]] = True
    docs, names = [], []
    for level in range(1, max(levels) + 1):
        a, first = _level(a, first)
        if level in levels:
            docs.append(full[np.cumsum(first) - 1])
            names.append(mix(a ^ U(level)))
    return np.concatenate(docs), np.concatenate(names)


def fingerprints(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The k smallest distinct 32-bit names of each text, ascending."""
    out: list[np.ndarray] = []
    for lo, hi in chunks([len(t) for t in texts], 1 << 20):
        doc, name = parse(texts[lo:hi])
        both = np.unique(doc.astype(U) << U(32) | name >> U(32))
        at = np.searchsorted(both, np.arange(hi - lo + 1).astype(U) << U(32))
        low = (both & U(0xFFFFFFFF)).astype(np.uint32)
        out += [low[x : min(x + k, y)] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common phrases: of the k smallest names of both, those that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    least = sorted(x | y)[:k]
    return sum(v in x and v in y for v in least) / len(least)


def encode(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NULL_ID = -(1 << 63)


def fingerprint_edits(docs: DataFrame, k: int = K, partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half comes from the next document by doc_id.

    Texts move once, compressed, to one bucket of ids each; the buckets' bounds are approximate quantiles that occur as ids, so
    the first document of a bucket is known and is sent to the bucket before it as well.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = partitions or max(least, min(stored_bytes(ids) // BUCKET_BYTES, count_rows(ids) // 1000))  # an estimate may be far too large
    found = ids.agg(F.min("id").alias("least"), F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("cuts")).first()
    bounds = np.array(sorted({x for x in [found.least, *(found.cuts or [])] if x is not None}), np.int64)[:n]

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            z = [pack(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            bucket = np.searchsorted(bounds, own, side="right") - 1
            head = np.flatnonzero(bounds[bucket] == own)  # such a row also ends the bucket before its own
            rows = np.r_[np.arange(len(own)), head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[bucket, (bucket[head] - 1) % len(bounds)].astype(np.int32)), pa.array(np.r_[np.zeros(len(own)), np.ones(len(head))].astype(np.int32)), pa.array(own[rows]), pa.array([z[i] for i in rows], pa.binary())],
                names=["bucket", "after", "id", "z"],
            )

    def score(batches):
        unpack = zstandard.ZstdDecompressor().decompress

        def done(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
            edited = []
            for _, t, following in pairs:
                h = len(t) // 2
                edited.append(t[: len(t) - h] + following[:h])
            raw = [t.encode() for _, t, _ in pairs]
            e_raw = [t.encode() for t in edited]
            next_print = fingerprints([pairs[-1][2].encode()], k)
            own, other = fingerprints(raw, k), fingerprints(e_raw, k)
            follow = [*own[1:], *next_print]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if i == _NULL_ID else i for i, _, _ in pairs], pa.int64()), pa.array([len(t) for _, t, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in e_raw]),
                    pa.array([encode(f) for f in own]), pa.array([encode(f) for f in other]), pa.array([likeness(f, g, k) for f, g in zip(own, other)]), pa.array([likeness(f, g, k) for f, g in zip(own, follow)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        last, pairs, total = None, [], 0
        for b in batches:
            for after, i, z in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                text = unpack(z).decode("utf-8", "replace")
                if last is not None:
                    pairs.append((*last, text))
                    total += len(last[1])
                    if total > 1 << 19:
                        yield done(pairs)
                        pairs, total = [], 0
                last = (i, text) if not after else None
                if after:
                    break
            else:
                continue
            break
        if pairs:
            yield done(pairs)
        for _ in batches:  # further copies of the following document
            pass

    dealt = ids.mapInArrow(deal, "bucket int, after int, id long, z binary")
    return dealt.repartitionById(max(len(bounds), 1), F.col("bucket")).sortWithinPartitions("after", "id", "z").mapInArrow(score, _OUT)

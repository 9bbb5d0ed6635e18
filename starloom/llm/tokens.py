"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact hash table of the token counts of frequent pre-tokens, fitted on about ``sample_docs`` documents and
broadcast (at most ``table_size`` entries of ``LONGEST`` characters); tier two encodes each miss once a worker and keeps it in a
bounded cache. Both hold exact lengths, so the sample decides about speed only, never about a count. No pre-token is ever shuffled.

The result equals the library's ``encode(text, add_special_tokens=False)``: a text is cut at special strings; parts whose
Unicode handling could differ are normalized and split by the library itself, others by an equal, faster pattern.

Defined results: null text counts as empty (0 bytes, 0 tokens); other columns pass through, those with the names of new ones are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_limits, count_rows, hash_share

#: The splitting pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose normal form and lower case are the same in every Unicode version at hand: up to Latin Extended-B, Greek and
#: Cyrillic without final-sigma cases, general punctuation.
_PLAIN = re.compile("[\t-\r -~\u00a0-\u0130\u0132-\u024f\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff]*")
#: Longer pre-tokens are neither in the table nor cached.
LONGEST = 64
#: Pre-tokens that a sampled document may add to the frequent ones.
_EACH = 1000


class PreTokens:
    """Splits texts as the vocabulary file does and counts the tokens of single pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.find = regex.compile(PATTERN).findall
        added = list(self.tok.get_added_tokens_decoder().values())
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("special strings that depend on their neighbours are not supported")
        self.strings = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.strings)))

    def split(self, text: str) -> tuple[list[str], list[str], int]:
        """The pre-tokens of a text as they stand, those that the library split off (in its own spelling), and the number of special strings."""
        parts = self.special.split(text) if any(s in text for s in self.strings) else [text]
        plain, mapped = [], []
        for part in parts:
            if part.isascii():
                plain += self.find(part.lower())
            elif _PLAIN.fullmatch(part):
                plain += self.find(unicodedata.normalize("NFC", part).lower())
            else:
                mapped += [piece for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return plain, mapped, len(parts) - 1

    def length(self, piece: str) -> int:
        """Tokens of a plain pre-token."""
        return len(self.tok.encode(piece, add_special_tokens=False))

    def mapped_length(self, piece: str) -> int:
        """Tokens of a pre-token in the library's spelling."""
        return len(self.tok.model.tokenize(piece))


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 2000, table_size: int = 30_000) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about sample_docs documents.

    One job; each task reports at most 1000 pre-tokens a sampled document and table_size in all, which bounds what the driver gets.
    """
    arrow_limits(docs.sparkSession)
    rows = count_rows(docs)

    def run(batches):
        pre, counts, n = pre_tokens(path), Counter(), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                counts.update(p for p in pre.split(t)[0] if len(p) <= LONGEST)
        top = counts.most_common(min(table_size, n * _EACH))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64()), pa.array([pre.length(k) for k, _ in top], pa.int32())], names=["piece", "n", "tokens"])

    few = docs.where(F.col("text").isNotNull() & hash_share(["text"], sample_docs, F.lit(rows))).select(F.col("text").cast("string"))
    counts, lengths = Counter(), {}
    for b in few.mapInArrow(run, "piece string, n long, tokens int").toArrow().to_batches():
        for piece, n, size in zip(*(c.to_pylist() for c in b.columns)):
            counts[piece] += n
            lengths[piece] = size
    return {k: lengths[k] for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:table_size]}


@lru_cache(2)
def pre_tokens(path: str) -> PreTokens:
    """One for each worker process."""
    return PreTokens(path)


class CompactTable:
    """The frequent pre-tokens and their lengths as they are broadcast: one sorted list and one array of four bytes an entry."""

    def __init__(self, lengths: dict[str, int]):
        self.keys = sorted(lengths)
        self.values = np.array([lengths[k] for k in self.keys], np.uint32)

    def as_dict(self) -> dict[str, int]:
        return dict(zip(self.keys, self.values.tolist()))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, sample_docs: int = 2000, table_size: int = 30_000, cache_size: int = 200_000) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    table = docs.sparkSession.sparkContext.broadcast(CompactTable(frequent_lengths(docs, path, sample_docs, table_size)))
    at = docs.columns.index("text")

    def make():
        pre, known, caches = pre_tokens(path), table.value.as_dict(), ({}, {})

        def total(pieces: list[str], cache: dict[str, int], encode) -> int:
            out = 0
            for p, n in Counter(pieces).items():
                size = known.get(p) if cache is caches[0] else None
                if size is None:
                    size = cache.get(p)
                    if size is None:
                        size = encode(p)
                        if len(p) <= LONGEST:
                            if len(cache) >= cache_size:
                                cache.clear()
                            cache[p] = size
                out += n * size
            return out

        def tokens(text: str) -> int:
            plain, mapped, special = pre.split(text)
            return special + total(plain, caches[0], pre.length) + (total(mapped, caches[1], pre.mapped_length) if mapped else 0)

        def call(b: pa.RecordBatch) -> list:
            texts = [x or "" for x in b.column(at).cast(pa.string()).to_pylist()]
            counts = [tokens(t) for t in texts]
            return [[len(t) if t.isascii() else len(t.encode()) for t in texts], counts, [n > limit for n in counts]]

        return call

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(docs, fields, make)

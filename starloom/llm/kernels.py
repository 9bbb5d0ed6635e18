"""NumPy text kernels: word hashes and shingle hashes of many texts at once.

A word is a maximal run of letters, digits and underscores of the lower-cased text; every non-ASCII character counts as part
of a word except spaces and general punctuation. All hashes are 64-bit and depend on the word's text only.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

U = np.uint64
_PIECE = 1 << 18
_BASE = U(0x9E3779B97F4A7C15 | 1)
_NOT_WORD = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⁯₠-⃏←-⯿　-〿︰-﹏＀-／]+")

_WORD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum() or _b == 95:
        _WORD[_b] = _b


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POW = _INV = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            inv = U(pow(int(_BASE), -1, 1 << 64))
            _POW = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _BASE, U)]))
            _INV = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, inv, U)]))
    return _POW, _INV


def normal(text: str | None) -> bytes:
    """The lower-cased UTF-8 of a text, with non-ASCII punctuation as spaces."""
    if not text:
        return b""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if _NOT_WORD.search(text):
            text = _NOT_WORD.sub(" ", text)
    return text.lower().encode("utf-8", "replace")


def _word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a buffer that neither begins nor ends inside a word."""
    cls = _WORD[buf]
    inside = np.empty(len(cls) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = cls != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(max(_PIECE, len(cls) + 1))
    with np.errstate(over="ignore"):
        total = np.empty(len(cls) + 1, U)
        total[0] = 0
        np.cumsum(cls.astype(U) * power[: len(cls)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        h += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h), starts, ends


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words, length in bytes of each word)."""
    parts = [normal(t) for t in texts]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    ends_of = np.cumsum(lengths)
    data = b" ".join(parts)
    buf = np.frombuffer(data, np.uint8)
    hs, ps, ls, at = [], [], [], 0
    while at < len(buf):
        end = min(at + _PIECE, len(buf))
        if end < len(buf) and _WORD[buf[end]]:
            piece = np.flatnonzero(_WORD[buf[at:end]] == 0)
            if len(piece):
                end = at + int(piece[-1]) + 1
            else:  # one word longer than a piece
                rest = np.flatnonzero(_WORD[buf[end:]] == 0)
                end = end + int(rest[0]) if len(rest) else len(buf)
        h, s, e = _word_spans(buf[at:end])
        hs.append(h)
        ps.append(s + at)
        ls.append(e - s)
        at = end
    if not hs:
        return np.empty(0, U), np.zeros(len(parts) + 1, np.int64), np.empty(0, np.int64)
    h, p, n = np.concatenate(hs), np.concatenate(ps), np.concatenate(ls)
    return h, np.concatenate([[0], np.searchsorted(p, ends_of)]).astype(np.int64), n


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of width words, offsets of each text's runs); a text of fewer words has one run of all of them."""
    h, at, _ = words(texts)
    return windows(h, at, width)


def windows(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    begin = np.repeat(at[:-1] - offsets[:-1], runs) + np.arange(offsets[-1])
    last = np.repeat(at[1:], runs)
    out = np.zeros(len(begin), U)
    padded = np.concatenate([h, np.zeros(width, U)])
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + np.where(begin + k < last, padded[begin + k], U(0))
    return mix(out), offsets


def chunks(lengths: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of consecutive rows with about most bytes of text in each; a longer row stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out

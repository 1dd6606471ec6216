"""Words and word shingles of whole texts as 64-bit hashes, vectorised with NumPy.

A text is lower-cased; its words are the maximal runs of ASCII letters and
digits and of bytes from 0x80 up in UTF-8. All other characters separate.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Separators become spaces, word bytes stay.
_KEEP = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
_BASE, _GOLD = 0x9E3779B97F4A7C55 | 1, 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def normalise(text: str | None) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_KEEP).split())


def digest(words: bytes) -> bytes:
    """128-bit digest of a normalised text."""
    return hashlib.md5(words, usedforsecurity=False).digest()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        p, q = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        p[0] = q[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(p), np.cumprod(q)
    return _POWERS[size]


def _hash_slice(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = buf > 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, q = _powers(len(buf) + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(buf.astype(_U) * p[: len(buf)])))
    h = (total[end] - total[start]) * q[start]
    return start, mix(h + (end - start).astype(_U) * _U(_GOLD))


def word_hashes(buf: bytes, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of each word of a normalised buffer; works in slices that end between words."""
    a, at, starts, hashes = np.frombuffer(buf, np.uint8), 0, [], []
    while at < len(a):
        to = min(len(a), at + most)
        if to < len(a):
            back = buf.rfind(b" ", at, to)
            to = back if back > at else (buf.find(b" ", to) if buf.find(b" ", to) > 0 else len(a))
        s, h = _hash_slice(a[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_hashes(docs: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash) of all shingles of normalised texts, repeats included, in text order.

    A text of one to width - 1 words has one shingle, all its words; one without words has none.
    """
    buf = b" ".join(docs)
    at = np.cumsum([0, *(len(d) + 1 for d in docs)])
    start, h = word_hashes(buf)
    doc = np.searchsorted(at, start, "right") - 1
    n = np.bincount(doc, minlength=len(docs)) if len(doc) else np.zeros(len(docs), np.int64)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    short = np.flatnonzero((n > 0) & (n < width))
    parts_d, parts_h = [], []
    if len(h) >= width:
        s = np.zeros(len(h) - width + 1, _U)
        for k in range(width):
            s = mix(s + h[k : len(h) - width + 1 + k] + _U(_GOLD))
        same = doc[: len(s)] == doc[width - 1 :]
        parts_d.append(doc[: len(s)][same])
        parts_h.append(s[same])
    if len(short):
        parts_d.append(short)
        parts_h.append(np.array([_short(h[first[i] : first[i] + n[i]]) for i in short], _U))
    if not parts_d:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    d, s = np.concatenate(parts_d), np.concatenate(parts_h)
    if len(parts_d) > 1:
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
    return d, s


def _short(h: np.ndarray) -> np.uint64:
    s = np.full(1, len(h), _U)
    for x in h:
        s = mix(s + x + _U(_GOLD))
    return s[0]


def shingle_set(text: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text, sorted, with their counts."""
    return np.unique(shingle_hashes([normalise(text)], width)[1], return_counts=True)

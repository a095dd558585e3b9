"""Words of a text, and 64-bit hashes of its words and word shingles, computed over whole arrays.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; A-Z count as a-z. All separators are
ASCII, so the UTF-8 bytes can be worked on directly.
"""

from __future__ import annotations

import numpy as np
import xxhash

_FROM = bytes(range(256))
_TO = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TABLE = bytes.maketrans(_FROM, _TO)

_CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        _POW.extend((_powers(_P, _CHUNK + 1), _powers(pow(_P, -1, 1 << 64), _CHUNK + 1)))
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def normalise(text: str) -> bytes:
    """The text's UTF-8 bytes with A-Z lowered and each separator a space; as long as the bytes of the text."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE)


def _hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = b != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if len(b) > _CHUNK:  # a giant word among few
        return np.array([xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
    power, inverse = _tables()
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin])


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each word of normalised bytes, in order. Long texts are taken in pieces cut at spaces."""
    if len(data) <= _CHUNK:
        return _hashes(data)
    out, at = [], 0
    while at < len(data):
        to = len(data) if len(data) - at <= _CHUNK else data.rfind(b" ", at, at + _CHUNK)
        if to <= at:
            to = data.find(b" ", at + _CHUNK)
            to = len(data) if to < 0 else to
        out.append(_hashes(data[at:to]))
        at = to + 1 if to > at else at + 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive items; of all items if there are fewer than n, but not none."""
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    acc = np.full(m, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        acc = (acc ^ h[k : k + m]) * np.uint64(0x9FB21C651E98DF25)
        acc = acc ^ (acc >> np.uint64(29))
    return mix(acc)


def shingle_set(data: bytes, n: int = 5) -> np.ndarray:
    """The sorted set of hashes of n-word shingles."""
    return np.unique(grams(word_hashes(data), n))

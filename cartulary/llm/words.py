"""Word hashes of many texts at once, without a Python object per word.

Words are the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lowered.
A word's hash is a polynomial of its UTF-8 bytes modulo 2**64, mixed once more.
"""

from __future__ import annotations

import numpy as np

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words start in them (one more at the end)."""
    raw = [t.encode().translate(_TABLE) for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    flat = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", np.uint8)
    inside = flat != 0x20
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * _powers(_BASE, len(flat)), out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(flat))[begin] + (end - begin).astype(np.uint64) if len(begin) else np.zeros(0, np.uint64))
    return hashes, np.append(0, np.searchsorted(begin, ends)).astype(np.int64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)

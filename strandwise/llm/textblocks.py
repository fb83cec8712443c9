"""Vectorised hashing of many documents at once, in numpy: words, shingles and rolling byte windows.

Documents of a block are laid one after another in one byte array; results carry the document's position in the block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd base and its inverse modulo 2**64 for prefix polynomial hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = BASE**i times the polynomial of data[i:j]; one entry more than ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    lengths = (end - start).astype(np.uint64)
    return mixed((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start] + lengths * np.uint64(0x632BE59BD9B4E019))


@dataclass
class Words:
    """Words of a block: document position, hash, first byte and end; ``first`` has each document's first word, one entry more."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offset: np.ndarray


#: Separators of `[^\x20\x09-\x0D]+` among the 256 bytes; UTF-8 has them nowhere else.
SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def words(texts: list[bytes], separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that aren't ``separators``, by document."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offset = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=offset[1:])
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~separators[data]
    inside[offset[1:] - 1] = False
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(offset, start, side="right") - 1
    first = np.searchsorted(start, offset)
    return Words(doc, span_hashes(prefix_hashes(data), start, end), start - offset[doc], end - offset[doc], first, offset)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that lie in one document, and the index of their first word."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[at + k]
    return mixed(h), at

"""Texts as flat numpy arrays of code points, so that per-character work is
vectorised over many documents at once."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

POINTS = 0x110000
CHUNK = 400_000


@lru_cache(maxsize=None)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def release() -> None:
    """Hand freed memory back to the system: a worker that is kept for later
    tasks otherwise stays as large as its largest batch made it."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def released(batches):
    """The batches, with `release` after each one has been dealt with."""
    for batch in batches:
        yield batch
        del batch
        release()


def chunks(texts: list, limit: int = CHUNK):
    """Yield (first, last) index ranges of about `limit` characters; a longer
    single text is a range of its own and is never cut."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one newline, and the n + 1
    offsets of the texts in that array.  Null counts as the empty text."""
    texts = [t or "" for t in texts]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lens)])


@lru_cache(maxsize=None)
def lower_table() -> np.ndarray:
    """One-to-one lower-casing; characters whose lower case is longer stay."""
    out = np.arange(POINTS, dtype=np.uint32)
    for i in range(0x1F000):
        c = chr(i).lower()
        if len(c) == 1:
            out[i] = ord(c)
    return out


@lru_cache(maxsize=None)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(POINTS)), np.bool_, POINTS)


@lru_cache(maxsize=None)
def word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(POINTS)), np.bool_, POINTS)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)

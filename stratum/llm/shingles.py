"""Words and word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
CACHE_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def release() -> None:
    """Gives memory back when a task ends: its Python worker stays while others run."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 with A-Z in lower case; bytes.split parts at just the six white-space characters."""
    return (text or "").encode().lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; with fewer words the whole sequence is one; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(_hashes.__getitem__, words), U, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    out = np.full(n, U(width))
    for i in range(width):
        out = mix(out * _A + h[i : i + n] * _B + _C)
    return np.unique(out)

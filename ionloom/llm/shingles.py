"""Word shingles of texts as 64-bit hashes, and MinHash signatures over them; numpy inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from ionloom.llm.common import claim_caches

#: Words whose hashes a worker keeps, about 15 MB; memory of the cache only.
CACHED_WORDS = 100_000
_FACTOR = np.uint64(0x9FB21C651E98DF25)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def claim_hashes() -> None:
    """For tasks that hash words: lets go of what other operators remember."""
    claim_caches("word hashes", _HASHES.clear)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of `length` words."""
    n = len(hashes) - length + 1
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = out * _FACTOR + hashes[i : i + n]
    return mix(out)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `words` words, A-Z in lower case.

    Words are the runs of characters other than ASCII white space, which is how bytes are split. Fewer words
    than a shingle are one shingle of their own; a text without words has none.
    """
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(words, len(hashes))))


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 2**64, count, np.uint64) | np.uint64(1), draw.integers(0, 2**64, count, np.uint64)


def min_hashes(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest image of a shingle, of which the upper 32 bits are kept."""
    out = np.empty(len(factors), np.uint64)
    for i in range(len(factors)):
        out[i] = (shingles * factors[i] + offsets[i]).min()
    return (out >> np.uint64(32)).astype(np.uint32)

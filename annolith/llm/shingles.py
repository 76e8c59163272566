"""Word shingles as 64-bit hashes, and b-bit MinHash signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

from annolith.llm.common import CACHES

#: Hash functions in a signature, bands, rows of a band, bits kept of each minimum.
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 < 5e-8.
PERMUTATIONS, BANDS, ROWS, KEPT_BITS = 256, 32, 4, 4

_RNG = np.random.default_rng(20_240_817)
_A = (_RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word (bytes), kept while there are fewer than `most`."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = WordHashes()
CACHES.append(_WORDS)


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; of the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the contract's white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    value = np.full(n, np.uint64(min(width, len(h))))
    for k in range(min(width, len(h))):
        value = mix(value * _GOLD + h[k : k + n])
    return np.unique(value)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):  # a block stays in the processor's cache
        out = np.minimum(out, (x[None, at : at + 2048] * _A + _B).min(axis=1))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its number and its rows' full minima."""
    value = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)
    for column in least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64).T:
        value = mix(value * _GOLD + column)
    return value.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """KEPT_BITS low bits of each (mixed) minimum, as bytes."""
    low = (mix(least.astype(np.uint64) + _GOLD) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)
    bits = ((low[:, None] >> np.arange(KEPT_BITS, dtype=np.uint8)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(-1))


def estimate(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Similarity estimates of packed signatures (rows of bytes), corrected for chance agreement of the kept bits."""
    differ = one ^ two
    # One bit a function that disagrees: fold each group of KEPT_BITS bits by or, then count.
    folded = (differ | (differ >> 1) | (differ >> 2) | (differ >> 3)) & np.uint8(0x11)
    agree = 1 - np.bitwise_count(folded).sum(axis=-1) / PERMUTATIONS
    chance = 2.0**-KEPT_BITS
    return (agree - chance) / (1 - chance)

"""64-bit hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(int(_RNG.integers(0, 1 << 62)) * 8 + 5)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
ODD = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)

#: What separates words: ASCII white space, or all of ASCII but letters and digits.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
    return cache["up"], cache["down"]


def word_hashes(texts: list[bytes], breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's begin (one more entry than texts).

    A word's hash is a polynomial in its bytes' random values; differences of running sums, scaled by the inverse
    power of where the word begins, give the polynomials of all words without a loop.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    gap = breaks[data]
    begins = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * down[: len(data)], out=sums[1:])
    words = mixed((sums[ends] - sums[begins]) * up[begins] + (ends - begins).astype(np.uint64))
    return words, np.searchsorted(begins, np.cumsum([1] + [len(t) + 1 for t in texts]))

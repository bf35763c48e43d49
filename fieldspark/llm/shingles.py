"""Words and word shingles of many texts at once, as 64-bit hashes computed over whole byte arrays.

A word's hash is a polynomial over random byte values, taken from running sums of the
lower-cased bytes (modulo 2**64, with an odd base, so positions divide out); a shingle
combines the hashes of five words in order. Nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
BLOCK = 1 << 20
_U = np.uint64
_seed = np.random.default_rng(20250101)
BYTES = _seed.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]  # A-Z count as a-z
PLACES = _seed.integers(0, 1 << 64, WIDTH, dtype=np.uint64) | _U(1)
SHORT = _seed.integers(0, 1 << 64, WIDTH + 1, dtype=np.uint64)
BASE = int(_seed.integers(0, 1 << 62)) * 4 + 3
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one entry more than texts)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data] * power[: len(data)])))
    h = scramble((sums[end] - sums[first]) * inverse[first])
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.searchsorted(first, begins)


def sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: of five words, or of all where there
    are fewer; none without words or text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= BLOCK):
            size += len(texts[end] or b"")
            end += 1
        h, begins = words([t or b"" for t in texts[at:end]])
        n = max(0, len(h) - WIDTH + 1)
        wide = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            wide += scramble(h[j : j + n] + PLACES[j]) * PLACES[j]
        wide = scramble(wide)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if b - a >= WIDTH:
                yield np.unique(wide[a : b - WIDTH + 1])
            elif b > a:
                yield scramble(np.sum(scramble(h[a:b] + PLACES[: b - a]) * PLACES[: b - a], keepdims=True) + SHORT[b - a])
            else:
                yield np.zeros(0, np.uint64)
        at = end

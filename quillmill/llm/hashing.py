"""Vectorised hashes of words and of runs of words, for many texts at a time."""

from __future__ import annotations

import numpy as np

#: What parts words: the ASCII white space of [\x09-\x0D\x20].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_RUN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in turn, and the place of each text's first word (with the end behind the last).

    fold: A-Z count as a-z. A word's hash is the sum of one random value for each (byte, place): sums of powers would let
    words of a regular build, such as a Thue-Morse word and its complement, meet.
    """
    raw = b"\n".join([*texts, b""])
    buf = np.frombuffer(raw.lower() if fold else raw, np.uint8)
    solid = ~SPACE[buf]
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    edges = np.cumsum([0, *(len(x) + 1 for x in texts)])
    offsets = np.searchsorted(first, edges)
    if not len(first):
        return np.zeros(0, np.uint64), offsets
    behind = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    sizes = behind - first
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    value = np.add.reduceat(_letters(buf[solid], place, int(sizes.max())), begin)
    return mix(value + sizes.astype(np.uint64) * _RUN), offsets


#: Places of a word whose values are looked up; those of later letters are worked out.
_NEAR = 64


def _values(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) * _PLACE + _RUN)


_TABLE = _values(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def _letters(byte: np.ndarray, place: np.ndarray, longest: int) -> np.ndarray:
    """The random value of each byte at its place in its word."""
    if longest <= _NEAR:
        return _TABLE[(place << 8) | byte]
    out = _TABLE[(np.minimum(place, _NEAR - 1) << 8) | byte]
    far = np.flatnonzero(place >= _NEAR)
    out[far] = _values(byte[far], place[far])
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """For each place the hash of the n words from there; n - 1 places fewer than words. Texts' ends are the caller's."""
    if n == 1 or len(words) < n:
        return words if n == 1 else words[:0]
    half = n // 2
    part = run_hashes(words, half)
    power = _RUN
    with np.errstate(over="ignore"):
        joined = part[: len(part) - half] * powers(power, half + 1)[half] + part[half:]
        return joined if n % 2 == 0 else joined[: len(joined) - 1] * power + words[n - 1 :]

"""Hashed words and word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The powers of an odd factor and of its inverse modulo 2 ** 64, n of them at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(_FACTOR), pow(int(_FACTOR), -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return _POWERS


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of values from a start to an end (exclusive): differences of the
    prefix sums of a polynomial, so that a run costs the same whatever its length."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _FACTOR)


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of the words of a text: what white space parts, with A-Z lower-cased. Eight
    bytes at a time are scrambled with their number in the word and added up. No power of a
    factor is involved, so no pattern of letters makes hashes agree, and words of up to eight bytes
    and equal length never share one."""
    raw = (text or "").encode("utf-8", "replace").lower()
    flat = np.frombuffer(raw + bytes(8), np.uint8)
    own = flat[:-8]
    inside = np.concatenate([[False], (own != 32) & ((own < 9) | (own > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    pieces = (sizes + 7) >> 3
    firsts = np.cumsum(pieces) - pieces
    number = np.arange(firsts[-1] + pieces[-1]) - np.repeat(firsts, pieces)
    left = np.minimum(np.repeat(sizes, pieces) - 8 * number, 8).astype(np.uint64)
    windows = np.ndarray((len(own) + 1,), "<u8", buffer=flat.data, strides=(1,))  # eight bytes from each byte on
    values = windows[np.repeat(starts, pieces) + 8 * number] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) << np.uint64(3)))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(values + mix(number.astype(np.uint64), 17)), firsts)
        return mix(sums + sizes.astype(np.uint64) * _FACTOR)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order; fewer words are one shingle."""
    n = len(words)
    if not n:
        return words
    own = min(n, size)
    with np.errstate(over="ignore"):
        out = np.full(n - own + 1, own, np.uint64)
        for i in range(own):
            out = out * _FACTOR + words[i : n - own + 1 + i]
    return mix(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text), size))

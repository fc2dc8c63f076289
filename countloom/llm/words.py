"""Hashes of words and of word windows, vectorised over a text."""

from __future__ import annotations

import functools

import numpy as np

from .common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PIECE = 1 << 20


@functools.lru_cache(12)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n of each."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(BASE)) -> np.ndarray:
    """Polynomial hash, mixed, of values[start:end] for each pair; ``values`` are 64-bit."""
    up, down = powers(base, 1 << max(16, int(len(values)).bit_length()))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.lru_cache(1)
def word_characters() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@functools.lru_cache(1)
def character_values() -> np.ndarray:
    """A 64-bit value for each code point."""
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


def normal_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the lower-cased texts, and how many words each has; words are runs of letters and digits."""
    low = [t.lower() for t in texts]
    joined = "\n".join(low)
    out, places = [], []
    at = 0
    while at < len(joined):
        end = min(len(joined), at + PIECE)
        while end < len(joined) and joined[end - 1].isalnum() and joined[end].isalnum():
            end += 1  # a word is never cut
        s = np.frombuffer(joined[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = runs(word_characters()[s])
        out.append(spans_hash(character_values()[s], starts, ends))
        places.append(starts + at)
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
    return np.concatenate(out), np.diff(np.searchsorted(np.concatenate(places), begin))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` words in a row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * BASE + words[k : k + n]
    return mix64(h)

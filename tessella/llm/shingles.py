"""Word shingles as 64-bit numbers, and fast similarity sketches of their sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from tessella.llm.memo import lease

KEPT_WORDS = 300_000
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _memo() -> dict[bytes, int]:
    return {}


def word_numbers(words: list[bytes]) -> np.ndarray:
    """64-bit numbers of words, kept per Python worker."""
    memo = _memo()
    lease("shingles", _memo.cache_clear)
    if len(memo) > KEPT_WORDS:
        memo.clear()
    try:
        return np.fromiter(map(memo.__getitem__, words), _U, len(words))
    except KeyError:
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), _U, len(words))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: A-Z in lower case, words between ASCII white space. A text of
    fewer words is one shingle; without words the set is empty."""
    out = []
    for lo in range(0, len(texts), 256):
        lists = [(t or "").encode().lower().split() for t in texts[lo : lo + 256]]
        numbers = word_numbers([w for ws in lists for w in ws])
        rolled = None
        if len(numbers) >= width:
            n = len(numbers) - width + 1
            rolled = np.zeros(n, _U)
            for k in range(width):
                rolled = (rolled + numbers[k : k + n] * _ODD[k % 5]) * _ODD[(k + 2) % 5]
            rolled = mix(rolled)
        at = 0
        for ws in lists:
            n = len(ws)
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                short = _U(n)
                with np.errstate(over="ignore"):
                    for x in numbers[at : at + n]:
                        short = short * _ODD[0] + x * _ODD[1]
                out.append(mix(np.array([short], _U) ^ _U(0x5BF03635)))
            else:
                out.append(np.zeros(0, _U))
            at += n
    return out


def sketch(values: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: coordinate b is the least of round + hash over all throws into bin b.

    In round i < size every element is thrown into a hashed bin; in round size + b it is thrown into bin b,
    so after 2*size rounds every coordinate is filled. It ends after the first round that leaves no bin
    empty, about size*log(size)/len(values) rounds. Two sketches agree in a coordinate with the sets'
    Jaccard similarity as probability, concentrated as for independent coordinates.
    """
    out = np.full(size, ~_U(0), _U)
    first, n = 0, len(values)
    if not n:
        return out
    step = max(1, min(2 * size, -(-6 * size // n)))  # later rounds never win over earlier ones, so several at once are fine
    while first < 2 * size:
        rounds = np.arange(first, min(first + step, 2 * size), dtype=np.uint64)
        h = mix(values[None, :] + mix(rounds * _ODD[1] + _ODD[0])[:, None])
        hashed = ((h >> _U(32)) * _U(size)) >> _U(32)
        bins = np.where(rounds[:, None] < size, hashed, rounds[:, None] - _U(size) * (rounds[:, None] >= size))
        key = (rounds[:, None] << _U(32)) | (h & _U(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel().astype(np.intp), key.ravel())
        if out.max() != ~_U(0):
            return out
        first += step
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit number per band of `rows` coordinates, the band's number mixed in."""
    grid = coordinates[: len(coordinates) // rows * rows].reshape(-1, rows)
    acc = mix(np.arange(len(grid), dtype=np.uint64) + _ODD[3])
    for k in range(rows):
        acc = mix(acc * _ODD[0] + grid[:, k])
    return acc

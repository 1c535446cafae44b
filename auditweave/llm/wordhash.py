"""Vectorised words, word hashes and hashes of word runs over UTF-8 buffers.

All functions work on a buffer that holds many texts one after another, so that the
cost of a NumPy call is shared; words never reach across texts.
"""

from __future__ import annotations

import numpy as np

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: Powers of the bases; tables of up to KEPT_POWERS numbers are kept by a worker.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT_POWERS = 1 << 21


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """1 for bytes of words, 0 for bytes in the given ranges."""
    out = np.ones(256, np.uint8)
    for a, b in excluded:
        out[a : b + 1] = 0
    return out


#: Words of non-blank characters, and words of letters, digits and characters beyond ASCII in lower case.
BLANK_SEPARATED = byte_class([(0x09, 0x0D), (0x20, 0x20)])
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
ANY_CASE = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])  # the same words before A-Z are in lower case
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        b, out = BASES[base], []
        for x in (b, np.uint64(pow(int(b), -1, 1 << 64))):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = out[0], out[1]
        if size <= KEPT_POWERS:
            _powers[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = kind[raw]
    edge = np.empty(len(raw) + 1, np.uint8)
    edge[0] = edge[-1] = 1
    edge[1:-1] = w[1:] != w[:-1]
    edge[offs] = 1
    at = np.flatnonzero(edge)
    inside = w[at[:-1]] != 0
    starts, ends = at[:-1][inside], at[1:][inside]
    return starts, ends, np.searchsorted(starts, offs)


def run_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], from run_sums; equal runs hash alike wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts] + (ends - starts).astype(np.uint64) * BASES[base])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hash(run_sums(raw.astype(np.uint64) + np.uint64(1), 0), starts, ends, 0)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(x[i : i + width]) for every full window."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out

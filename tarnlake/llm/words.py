"""Words of many texts at once, as 64-bit hashes, without a Python object per word.

A word is a run of bytes that are not white space (0x20, 0x09-0x0D), with A-Z in lower case. Its hash is a
polynomial over the whole ring of 64-bit integers with a random table of byte values, mixed at the end; it
depends on nothing but the word, so it agrees between tasks, runs and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    code[65:91] += _U(32)
    return mix(code * _U(BASE) + _U(0x2545F4914F6CDD1D))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large-string array without nulls, and where each text begins and ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word. Words are hashed in blocks of about a megabyte."""
    values, out = _byte_values(), np.empty(len(starts), np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    up = down = np.empty(0, np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low > len(up):
            up, down = _powers(max(high - low, _BLOCK), BASE), _powers(max(high - low, _BLOCK), inverse)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and how many words each text has."""
    data, offsets = buffers(texts)
    starts, ends, counts = word_spans(data, offsets)
    return hash_spans(data, starts, ends), counts


def runs(hashes: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words within a text, and how many each text has."""
    have = np.maximum(counts - length + 1, 0)
    if not have.sum():
        return np.empty(0, np.uint64), have
    n = len(hashes) - length + 1
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = mix(total + hashes[k : k + n] * _U(2 * k + 3))
    first = np.cumsum(counts) - counts
    begin = np.cumsum(have) - have
    where = np.repeat(first - begin, have) + np.arange(have.sum())
    return total[where], have

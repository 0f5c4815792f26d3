"""Words and 5-word shingles of whole Arrow columns as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from polarity.llm.common import ship_by_value

ship_by_value(__name__)

WIDTH = 5
_RNG = np.random.default_rng(11)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column, where each text begins, the end last); null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def hash_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word, A-Z lower-cased; no word runs across a bound."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[raw]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = space[:-1]
    begins[bounds[:-1][bounds[:-1] < n]] = True
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = begins[1:] | space[1:]
    word = ~space
    start, end = np.flatnonzero(begins & word), np.flatnonzero(ends & word) + 1
    data = np.zeros(n + 8, np.uint8)
    data[:n] = _LOWER[raw]
    eight = np.ndarray((n + 1,), "<u8", data, strides=(1,))        # the 8 bytes from each place on
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.arange(len(start))
    done = 0
    while len(live):            # a round for each 8 bytes, of the words that have them
        left = size[live] - done
        chunk = eight[start[live] + done]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = mix(h[live] ^ chunk) * np.uint64(0xD6E8FEB86659FD93)
        done += 8
        live = live[left > 8]
    return mix(h), start


def group_shingles(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, hash) of the 5-word shingles of each group of words, in reading order, repeats
    included; of a group of fewer words the whole sequence.  ``size``: words of each group."""
    first = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    left = np.repeat(first + size, size) - np.arange(len(h))           # words from here to the group's end
    padded = np.concatenate([h, np.zeros(WIDTH, np.uint64)])
    total = np.full(len(h), np.uint64(WIDTH)) * _MULTIPLIERS[WIDTH]
    for j in range(WIDTH):
        total += padded[j:j + len(h)] * _MULTIPLIERS[j]
    whole = left >= WIDTH
    short = np.flatnonzero((size > 0) & (size < WIDTH))                # their one shingle stands at the first word
    at = first[short]
    value = size[short].astype(np.uint64) * _MULTIPLIERS[WIDTH]
    for j in range(WIDTH - 1):
        value += np.where(size[short] > j, padded[at + j], np.uint64(0)) * _MULTIPLIERS[j]
    total[at] = value
    whole[at] = True
    return group[whole], mix(total[whole])


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; none for a text without words.  Two shingles
    share a hash with probability 2**-64."""
    raw, bounds = utf8(texts)
    h, start = hash_words(raw, bounds)
    size = np.diff(np.searchsorted(start, bounds))
    group, value = group_shingles(h, size)
    edges = np.searchsorted(group, np.arange(len(size) + 1))
    return [distinct(value[s:e]) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]

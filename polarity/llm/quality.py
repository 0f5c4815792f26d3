"""Quality rules: repetition inside a text by its suffix array.

A text's suffix array is built by prefix doubling (numpy, one text at a time); neighbouring
suffixes' longest common prefixes are read off the doubling ranks.  A run of neighbours with
common prefixes of at least ``min_repeat`` characters is an interval of one repeated substring;
extending every suffix to its longest common prefix and dropping those that an earlier one
covers leaves the maximal repeats.  Their spans are united; a text is rejected if they cover
too large a fraction of it or if one repeat is too long a fraction of it.

Defined results: null or empty text has no words and fails the base rule; texts are read whole,
memory is proportional to the longest text; rows are judged one by one, so ties, repeated rows
and null ids keep their row; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polarity.llm.common import ship_by_value

ship_by_value(__name__)

MIN_REPEAT = 50          # characters a repeated substring must have to count
MAX_COVERED = 0.3        # fraction of the text's characters inside repeats
MAX_LONGEST = 0.25       # longest repeat as a fraction of the text's characters
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_WINDOW = 5


def _dense(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes renumbered 1..k in order, and k."""
    present = np.bincount(codes) > 0
    renumber = np.cumsum(present)
    return renumber[codes].astype(np.int64), int(renumber[-1])


def suffix_array(codes: np.ndarray):
    """Suffix array of non-negative integer codes.

    Returns (sa, packed, bits, per, levels): packed holds each suffix's first ``per`` codes of
    ``bits`` bits; levels are (h, rank) pairs, rank equal exactly where h codes are equal.
    """
    n = len(codes)
    dense, k = _dense(codes)
    bits = k.bit_length()
    per = min(63 // bits, 16)
    padded = np.concatenate([dense, np.zeros(per, np.int64)])
    packed = np.zeros(n, np.int64)
    for j in range(per):
        packed <<= bits
        packed |= padded[j:j + n]
    sa = np.argsort(packed)
    ordered = packed[sa]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    rank = np.zeros(n + 1, np.int64)        # the entry behind the end ranks lowest
    rank[sa] = starts
    h, levels = per, []
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return sa, packed, bits, per, levels
        levels.append((h, rank.copy()))
        sub = sa[slots]
        behind = np.minimum(sub + h, n)
        key = rank[sub] * (n + 2) + rank[behind]
        o = np.argsort(key)
        sub, key = sub[o], key[o]
        sa[slots] = sub
        new = np.empty(len(slots), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first[slots] = new
        rank[sub] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        h *= 2


def common_prefixes(n: int, sa, packed, bits: int, per: int, levels, least: int):
    """Longest common prefix of each suffix with its predecessor in the suffix array (entry 0
    is 0); values under ``least`` may be given as 0."""
    lcp = np.zeros(n, np.int64)
    pairs = np.arange(1, n)
    for h, rank in levels:
        if h <= least:
            pairs = pairs[rank[sa[pairs]] == rank[sa[pairs - 1]]]
    if least > per and not levels or not len(pairs):
        return lcp
    a, b = sa[pairs - 1].copy(), sa[pairs].copy()
    got = np.zeros(len(pairs), np.int64)
    for h, rank in reversed(levels):
        same = (rank[a] == rank[b]) & (a < n) & (b < n)
        step = np.where(same, h, 0)
        got += step
        a += step
        b += step
    tail = np.append(packed, -1)
    step = 1 << (per.bit_length() - 1)
    while step:
        shift = bits * (per - step)
        x, y = tail[np.minimum(a, n)], tail[np.minimum(b, n)]
        same = (a + step <= n) & (b + step <= n) & ((x >> shift) == (y >> shift))
        add = np.where(same, step, 0)
        got += add
        a += add
        b += add
        step >>= 1
    lcp[pairs] = np.where(got >= least, got, 0)
    return lcp


def repeats(text: str, min_repeat: int = MIN_REPEAT) -> tuple[list[tuple[int, int]], int]:
    """(united spans of the maximal repeats as (start, end), length of the longest repeat)."""
    if len(text) < min_repeat + 1:
        return [], 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(codes)
    sa, packed, bits, per, levels = suffix_array(codes)
    lcp = common_prefixes(n, sa, packed, bits, per, levels, min_repeat)
    if not lcp.any():
        return [], 0
    reach = np.zeros(n, np.int64)               # longest repeat that starts at each position
    np.maximum.at(reach, sa, lcp)
    np.maximum.at(reach, sa[:-1], lcp[1:])
    at = np.flatnonzero(reach)
    ends = np.maximum.accumulate(at + reach[at])
    maximal = np.ones(len(at), bool)            # an earlier start reaches as far: not left-maximal
    maximal[1:] = ends[1:] > ends[:-1]
    at, ends = at[maximal], ends[maximal]
    opens = np.ones(len(at), bool)
    opens[1:] = at[1:] > ends[:-1]
    lo = np.flatnonzero(opens)
    hi = np.append(lo[1:], len(at)) - 1
    return list(zip(at[lo].tolist(), ends[hi].tolist())), int(reach.max())


def repeated_window_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    m, key = n - window + 1, ids
    for _ in range(window - 1):     # pair by pair, renumbered, so that keys stay exact
        size = int(key.max()) + 1
        key = key[:-1] * len(number) + ids[n - len(key) + 1:]
        if size * len(number) >= 1 << 31:
            key = np.unique(key, return_inverse=True)[1]
    o = np.argsort(key)
    s = key[o]
    eq = s[1:] == s[:-1]
    if not eq.any():
        return 0
    twice = np.zeros(m, bool)
    twice[o[1:][eq]] = True
    twice[o[:-1][eq]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += twice
    edge[window:window + m] -= twice
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def judge(text: str | None, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
          max_longest: float = MAX_LONGEST) -> tuple:
    """All signals of one text and the verdict, in the order of ``SIGNALS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    n_words = len(words)
    n_repeat = repeated_window_words(words)
    spans, longest = repeats(text, min_repeat)
    covered = sum(e - s for s, e in spans)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    kept = not failed and covered <= max_covered * len(text) and longest <= max_longest * len(text)
    return (n_words, len(text) - sum(text.count(c) for c in _SPACES),
            sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), n_repeat, failed,
            kept, covered, longest, len(spans))


SIGNALS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, covered_chars bigint, longest_repeat bigint, n_repeats bigint")
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: its id and the signals and verdict of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_py(), **limits) for t in b.column(1)]
            cols = zip(*rows) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, _ARROW))],
                                             names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in SIGNALS.split(", "))]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SIGNALS}")


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), **limits)[6] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

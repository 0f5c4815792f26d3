import math
from collections import Counter

import numpy as np
import pytest
from llm_cases import as_docs, edge_rows, prose, words_of

from polarity.llm.lm import ALPHA, UNSEEN, _bounds, _pack, _unpack, backoff_scores


def brute(rows, order=3):
    docs = [(i, words_of(t)) for i, t, *_ in rows]
    own = [Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)) for _, w in docs]
    total = Counter()
    for c in own:
        total.update(c)
    n_all, out = sum(len(w) for _, w in docs), []
    for (i, w), mine in zip(docs, own):
        def seen(g, mine=mine):
            return total[g] - mine[g]
        logs, by, unseen = [], [0] * order, 0
        for k in range(len(w)):
            top = min(order, k + 1)
            for n in range(top, 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                if n > 1 and seen(g) > 0:
                    logs.append(math.log(ALPHA) * (top - n) + math.log(seen(g) / seen(g[:-1])))
                    break
                if n == 1:
                    logs.append(math.log(ALPHA) * (top - 1) + math.log(max(seen(g), UNSEEN) / max(n_all - len(w), 1)))
                    unseen += seen(g) == 0
            by[order - n] += 1
        out.append((i, len(w), by, unseen, round(sum(logs) / len(w), 6) if w else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order, block", [(1, 1 << 22), (2, 3000), (3, 1 << 22), (3, 20000), (4, 50000)])
def test_scores_equal_brute_force(edge, order, block):
    got = backoff_scores(edge, order=order, block_bytes=block).collect()
    assert sorted([(r.id, r.n_words, r.by_order, r.n_unseen, None if r.score is None else round(r.score, 6)) for r in got], key=repr) == brute(edge_rows(), order)


def test_common_words(spark):
    rows = [(i, "the of the " + prose(i % 9, 6, 12) + " the of", "s") for i in range(120)] + [(500, "the", "s"), (501, "nowhere else", "s")]
    got = backoff_scores(as_docs(spark, rows), block_bytes=500).collect()
    assert sorted([(r.id, r.n_words, r.by_order, r.n_unseen, round(r.score, 6)) for r in got], key=repr) == brute(rows)


def test_nothing_and_blanks(spark, nothing):
    assert backoff_scores(nothing).count() == 0
    assert [(r.n_words, r.score) for r in backoff_scores(as_docs(spark, [(1, None, "a"), (2, "", "a"), (3, " ", "a")])).collect()] == [(0, None)] * 3
    assert [r.n_unseen for r in backoff_scores(as_docs(spark, [(1, "a b a", "a")])).collect()] == [3]


def test_packing_is_exact():
    for x in (np.array([0, 1, 2**64 - 1, 5], np.uint64), np.array([7], np.uint32), np.arange(1000, dtype=np.uint64) << np.uint64(40)):
        assert np.array_equal(_unpack(_pack(x), x.dtype), x)
    assert _bounds(np.array([0, 2**63 - 1, 2**63, 2**64 - 1], np.uint64), 2).tolist() == [0, 2, 4]

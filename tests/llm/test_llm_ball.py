import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polarity.llm.ball import Balls, vector_codes
from polarity.llm.q_ball import SQL, coded_embeddings


def brute(rows, parts=8, entries=16, rounds=6):
    """Rows (id, code, error, label_error, digest) by plain loops over every entry."""
    kept = []
    for key, vector, label in rows:
        if vector and len(vector) % parts == 0 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, label, [math.floor(4096 * float(np.float32(x))) for x in vector]))
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0, k[2]))
    if not kept:
        return []
    kept = [k for k in kept if len(k[2]) == len(kept[0][2])]
    w = len(kept[0][2]) // parts
    books = [[k[2][p * w:p * w + w] for k in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, _, v in kept:
                x = v[p * w:p * w + w]
                members.setdefault(nearest(x, books[p])[0], []).append(x)
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, per = [], {}
    for key, label, v in kept:
        found = [nearest(v[p * w:p * w + w], books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        per[label] = per.get(label, 0) + error
        out.append((key, label, "".join(f"{e:02x}" for e, _ in found), error))
    return sorted(((key, code, error, per[label], digest) for key, label, code, error in out), key=repr)


def vectors(seed, n, size=16):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        v = [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]
        if kind < 0.3:
            v = list(rng.choice(centres))                         # equal vectors: entries that tie
        elif kind < 0.4:
            v = [round(4 * x) / 4 for x in v]                     # parts at equal distances
        rows.append((i, [float(np.float32(x)) for x in v], rng.choice([0, 1, None, 2])))
    return rows


def odd(size=16):
    v = [0.5] * size
    return [(3, None, 1), (4, [], 1), (5, [None] + v[1:], 1), (6, [float("nan")] + v[1:], 1), (7, [float("-inf")] + v[1:], None),
            (8, v[:-1], 1), (9, v + v, 1), (None, v, None), (2, v, 1), (2, v, 1), (2, [-x for x in v], 1), (10, [0.0] * size, 1), (11, [1000.5] + v[1:], 5)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.withColumns({c: F.lit("own") for c in ("id", "v", "code", "error", "_label", "size", "label_error")})


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [vectors(1, 300), vectors(2, 90) + odd(), odd(), vectors(3, 10), [(1, [1.0] * 64, None)] * 40])
def test_equal_to_brute_force(spark, rows):
    want = brute(rows)
    assert result(coded_embeddings(frame(spark, rows))) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    for r in rows:
        con.execute("INSERT INTO embeddings VALUES (?, ?, ?)", list(r))
    assert sorted(map(tuple, con.execute(SQL).fetchall()), key=repr) == want


def test_nothing_kept(spark):
    assert result(coded_embeddings(frame(spark, []))) == []
    assert result(coded_embeddings(frame(spark, [(1, None, 2)]))) == []
    assert vector_codes(frame(spark, []))[1] is None


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        coded_embeddings(frame(spark, [(1, [1e30] * 16, 0)])).collect()


def test_balls_skip_and_agree():
    """The candidates that balls and rings leave hold the nearest entry, ties to the lower one, whatever the
    entries before; on parts that lie close most distances are skipped."""
    rng = np.random.default_rng(5)
    for spread in (3, 30, 3000):
        centres = rng.integers(-4000, 4000, (16, 8))
        x = centres[rng.integers(0, 16, 2000)] + rng.integers(-spread, spread + 1, (2000, 8))
        for book in (centres, np.vstack([centres[:8], centres[:8]])):
            full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            balls = Balls(book)
            for start in (np.zeros(2000, np.int64), rng.integers(0, 16, 2000), full.argmin(axis=1)):
                best, d, done = balls.assign(x, start)
                assert (best == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
            if spread < 3000 and book is centres:
                assert done == 2000                       # all in stable cores: one distance each


def test_other_parameters(spark):
    rows = vectors(8, 120, 12)
    got, books = vector_codes(frame(spark, rows), parts=3, entries=5, rounds=2)
    want = brute(rows, 3, 5, 2)
    assert sorted((r.id, "".join(f"{c:02x}" for c in r.code), r.error) for r in got.collect()) == sorted(w[:3] for w in want)
    assert books.sha256() == want[0][4] and books.books.shape == (3, 5, 4)

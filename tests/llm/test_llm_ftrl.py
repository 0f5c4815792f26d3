import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import LOWER, WORD, as_docs, edge_rows, prose
from pyspark.sql import functions as F

from polarity.llm import ftrl
from polarity.llm.ftrl import BITS, Learner, features, train
from polarity.llm.q_ftrl import op12_quality_classifier, quality_scores


def grams(text):
    """The n-grams of a text by plain rules."""
    words = WORD.findall(text or "")
    lower = [w.translate(LOWER) for w in words]
    forms = []
    for i, w in enumerate(words):
        f = re.sub("[a-z]|[^\x00-\x7f]", "\x80", w)
        f = re.sub("[A-Z]", "\x81", f)
        f = re.sub("[0-9]", "\x82", f)
        forms.append((re.sub(r"(.)\1+", r"\1", f, flags=re.S), lower[i] in lower[max(0, i - 2):i]))
    return ([("w", *lower[i:i + k]) for k in (1, 2) for i in range(len(words) - k + 1)]
            + [("f", *forms[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)])


TEXTS = ["The cat&&& sat THE cat\tsat", "", None, " \n ", "a", "É1 é22 --- -- x!!y", "same same same other same", "x" * 3000 + " y", prose(1, 800, 40), "a b\nc a b c"]


def test_features():
    owner, place, size = features(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        want = grams(t)
        assert size[i] == len(want) == (owner == i).sum()
        assert sorted(Counter(place[owner == i].tolist()).values()) == sorted(Counter(want).values())
    one = {}
    for i, t in enumerate(TEXTS):          # the same n-gram has the same place in every text
        for g, n in Counter(grams(t)).items():
            alone = features(pa.array([t]))
            assert sorted(alone[1].tolist()) == sorted(place[owner == i].tolist())
            one.setdefault(g, set()).add(n)
    assert len(features(pa.array([], pa.string()))[0]) == 0


def test_updates_equal_plain_ones():
    rng = np.random.default_rng(2)
    learner, z, n = Learner(), {}, {}
    bias = 1 << BITS

    def weight(i):
        a, l1 = z.get(i, 0.0), 0.0 if i == bias else ftrl.L1
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((ftrl.BETA + math.sqrt(n.get(i, 0.0))) / ftrl.ALPHA + ftrl.L2)

    for _ in range(300):
        at = rng.choice(60, rng.integers(0, 12), replace=False)
        x, y = rng.random(len(at)), int(rng.integers(0, 2))
        learner.learn(at, x, y)
        both = [*zip(at.tolist(), x.tolist()), (bias, 1.0)]
        w = {i: weight(i) for i, _ in both}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in both)))
        for i, v in both:
            g = (p - y) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / ftrl.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    got = learner.weights(np.append(np.arange(60), bias))
    assert got == pytest.approx([weight(i) for i in [*range(60), bias]], abs=1e-9)


def test_scores_are_dot_products(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert 0 < model.examples <= ftrl.SAMPLE
    dense = model.dense()
    texts = [r.text for r in docs.orderBy("doc_id").limit(20).collect()] + TEXTS
    got = model.scores(pa.array(texts), dense)
    for t, s in zip(texts, got):
        _, place, size = features(pa.array([t]))
        total = model.bias + sum(dense[p] * math.sqrt(c / size[0]) for p, c in Counter(place.tolist()).items())
        assert s == pytest.approx(1 / (1 + math.exp(-total)))
        assert 0 <= s <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = op12_quality_classifier(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 500
    good, bad = ([r.predicted for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) >= 0.995 and np.mean(bad) <= 0.03


def test_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (20, 0), (21, 0), (3, 1), (999, 0)], "doc_id bigint, quality int")
    got = quality_scores(edge, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in edge_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    blank = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(blank) == 1
    assert quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    again = {(r.doc_id, r.score) for r in quality_scores(edge.repartition(5), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_sample_bound(spark):
    docs = as_docs(spark, [(i, prose(i, 20), "s") for i in range(40)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert train(docs, labels, sample=15).examples == 15 and train(docs.union(docs), labels.union(labels), sample=15).examples == 15

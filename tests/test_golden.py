"""Hand-computed values of FIXTURES.md section 3."""

import math

import pytest

from polarity.config import Settings
from polarity.functions.text import clean, text_state, words
from polarity.functions.vecmath import euclidean, manhattan
from polarity.operators.cluster import assign_clusters, update_centroids
from polarity.operators.dictionary import build_dictionary
from polarity.operators.evaluate import confusion2, metrics2, outcome_counts
from polarity.operators.scoring import upsert_scores
from polarity.operators.vectors import score_space, vector_space

S2 = Settings(ngram_size=2)


def corpus(spark):
    return spark.createDataFrame([(1, "рад рад день", 1), (2, "день плохой", -1), (3, "день", 0)],
                                 "doc_id long, text string, emotion int")


def test_cleaning(spark):
    df = spark.createDataFrame([("Ёлка, test мир-ёж №5",), ("only english",), ("",)], "text string")
    r = df.select(words("text").alias("w"), clean("text").alias("c"), text_state("text").alias("s")).collect()
    assert r[0]["w"] == ["Ёлка", "мир", "ёж"] and r[0]["c"] == "Ёлка мир ёж" and r[0]["s"] == "ok"
    assert r[1]["w"] == [] and r[1]["s"] == "foreign"
    assert r[2]["s"] == "empty"


def test_cleaning_idempotent(spark):
    df = spark.createDataFrame([("Ёлка, test мир-ёж №5",)], "text string")
    once = df.select(clean("text").alias("t"))
    assert once.select(clean("t")).first()[0] == once.first()[0]


def test_dictionary(spark):
    d = {r["n_gramm"]: r for r in build_dictionary(corpus(spark), S2).collect()}
    exp = {"рад": (2, 0, 1, 0, 1.098612), "рад рад": (1, 0, 1, 0, 1.098612),
           "рад день": (1, 0, 1, 0, 1.098612), "день": (2, 1, 2, 1, 0.0),
           "день плохой": (0, 1, 0, 1, 1.098612), "плохой": (0, 1, 0, 1, 1.098612)}
    assert set(d) == set(exp)
    for g, (ip, inn, tp, tn, idf) in exp.items():
        r = d[g]
        assert (r["in_texts_p"], r["in_texts_n"], r["texts_with_p"], r["texts_with_n"]) == (ip, inn, tp, tn)
        assert r["idf"] == pytest.approx(idf, abs=1e-9)
    ids = sorted(r["n_gramm_id"] for r in d.values())
    assert ids == list(range(1, 7))
    by_id = [r["n_gramm"] for r in sorted(d.values(), key=lambda r: r["n_gramm_id"])]
    assert by_id == sorted(by_id, key=lambda s: s.encode())


def _weights(spark, settings):
    c = corpus(spark)
    d = build_dictionary(c, settings)
    names = {r["n_gramm_id"]: r["n_gramm"] for r in d.collect()}
    v = vector_space(c, d, settings).collect()
    return {r["doc_id"]: (r["n_terms"], r["norm"], {names[i]: w for i, w in zip(r["idx"], r["val"])}) for r in v}


def test_vectors_with_tf(spark):
    v = _weights(spark, S2)
    m, d, w = v[1]
    assert m == 4 and d == pytest.approx(1.902852, abs=1e-6)
    assert w["рад"] == pytest.approx(1.045248, abs=1e-6)
    assert w["рад рад"] == pytest.approx(0.522624, abs=1e-6)
    assert w["рад день"] == pytest.approx(0.522624, abs=1e-6)
    assert w["день"] == 0
    m, d, w = v[2]
    assert m == 3 and d == pytest.approx(1.553672, abs=1e-6)
    assert w["плохой"] == pytest.approx(0.568961, abs=1e-6)
    m, d, w = v[3]
    assert m == 1 and d == 0 and w == {"день": 0}


def test_vectors_without_tf(spark):
    v = _weights(spark, Settings(ngram_size=2, use_tf=False))
    assert v[1][2]["рад"] == pytest.approx(2.090496, abs=1e-6)
    assert v[2][2]["плохой"] == pytest.approx(1.706883, abs=1e-6)


def test_vector_indexes_increase(spark):
    c = corpus(spark)
    for r in vector_space(c, build_dictionary(c, S2), S2).collect():
        assert all(b > a for a, b in zip(r["idx"], r["idx"][1:]))


def test_serving_keeps_empty(spark):
    c = corpus(spark)
    d = build_dictionary(c, S2)
    t = spark.createDataFrame([("a", "день плохой"), ("b", "english only"), ("c", "")], "guid string, text string")
    r = {x["guid"]: x for x in score_space(t, d, S2).collect()}
    assert r["a"]["n_terms"] == 3 and r["b"]["n_terms"] == 0 and r["c"]["n_terms"] == 0


def test_two_class_metrics(spark):
    df = spark.createDataFrame(list(zip([1, -1, -1, -1, 1], [1, 1, 1, -1, -1])), "pred int, target int")
    c = confusion2(df).first()
    assert (c["tp"], c["fn"], c["tn"], c["fp"]) == (1, 2, 1, 1)
    std = metrics2(confusion2(df)).first()
    assert std["accuracy"] == pytest.approx(0.4)
    assert std["precision_pos"] == pytest.approx(0.5) and std["recall_pos"] == pytest.approx(1 / 3, abs=1e-6)
    leg = metrics2(confusion2(df), legacy=True).first()
    assert leg["precision_pos"] == pytest.approx(1 / 3, abs=1e-6) and leg["recall_pos"] == pytest.approx(0.5)


def test_five_class_outcomes(spark):
    rows = [(2, 2), (-1, -1), (-1, 1), (1, -2), (1, 2), (-2, -1), (0, 2), (0, 0)]
    df = spark.createDataFrame(rows, "pred int, target int")
    r = outcome_counts(df).first()
    assert (r["exact_pos"], r["exact_neg"], r["neg_for_pos"], r["pos_for_neg"]) == (2, 1, 1, 1)
    assert (r["off1_pos"], r["off1_neg"], r["off2_pos"], r["off_more"]) == (1, 1, 1, 0)
    assert r["total"] == 8 and r["accuracy"] == pytest.approx(3 / 8)


def test_kmeans_step(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, [10.0, 0.0]), (4, [10.0, 2.0])],
                                "id long, features array<double>")
    a = assign_clusters(pts, [[0.0, 0.0], [10.0, 0.0]], "euclidean")
    assert [r["cluster"] for r in a.orderBy("id").collect()] == [0, 0, 1, 1]
    c = {r["cluster"]: r["features"] for r in update_centroids(a).collect()}
    assert c[0] == [0.0, 1.0] and c[1] == [10.0, 1.0]


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 0.0], [10.0, 2.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(manhattan("a", "b").alias("m"), euclidean("a", "b").alias("e")).collect()
    assert r[0]["m"] == 12 and r[0]["e"] == pytest.approx(math.sqrt(104), abs=1e-6)
    assert r[1]["m"] == 0 and r[1]["e"] == 0


def test_writeback(spark):
    texts = spark.createDataFrame([("a", None), ("b", None), ("c", 1)], "guid string, temote int")
    scores = spark.createDataFrame([("a", 1, 1), ("a", 2, -1), ("b", 3, 0)], "guid string, seq int, label int")
    once = upsert_scores(texts, scores)
    assert {r["guid"]: r["temote"] for r in once.collect()} == {"a": -1, "b": 0, "c": 1}
    twice = upsert_scores(once, scores)
    assert sorted(twice.collect()) == sorted(once.collect())


def test_vectors_l2_norm(spark):
    """norm='l2' divides by the text's norm instead of multiplying (quirk 2, option)."""
    v = _weights(spark, Settings(ngram_size=2, norm="l2"))
    d = 1.902852
    assert v[1][2]["рад"] == pytest.approx(1.098612 * 2 / 4 / d, abs=1e-6)
    assert v[3][2] == {"день": 0}

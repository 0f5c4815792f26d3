"""Seeding in few passes (M9) against the k-pass seeding, and the whole trend report and audits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from polarity.config import LETTER_WORD, Settings
from polarity.operators import cluster
from polarity.plans import jobs
from polarity.plans import testbed as tb
from polarity.sources.files import read_category_table, scan_category_file

SF = "/root/testdata/sf0.001"


def _points(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def _cost(x, cents):
    d = ((x[:, None, :] - np.asarray(cents)[None, :, :]) ** 2).sum(2)
    return float(d.min(1).sum())


def test_cost_of_the_seeds(spark):
    pts = _points(spark).where(F.col("features").isNotNull()).persist()
    x = np.array([r["features"] for r in pts.collect()], float)
    few = [_cost(x, cluster.seed_oversampled(pts, 8, "euclidean", s, 2)) for s in range(20)]
    each = [_cost(x, cluster.seed_centroids(pts, 8, "euclidean", s, 2)) for s in range(20)]
    assert np.mean(few) <= 1.1 * np.mean(each)
    pts.unpersist()


@pytest.mark.parametrize("metric", cluster.METRICS)
def test_passes_do_not_grow_with_k(spark, monkeypatch, metric):
    calls = []
    real = cluster.assign_clusters
    monkeypatch.setattr(cluster, "assign_clusters", lambda *a, **k: calls.append(1) or real(*a, **k))
    pts = _points(spark)
    for k in (4, 30):
        calls.clear()
        seeds = cluster.seed_oversampled(pts, k, metric, 3)
        assert len(seeds) == k == len({tuple(s) for s in seeds}) and len(calls) == 6


def test_few_and_repeated_points(spark):
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "id int, features array<double>")
    assert sorted(map(tuple, cluster.seed_oversampled(same, 5))) == [(1.0, 0.0), (1.0, 1.0)]
    assert cluster.seed_oversampled(same.where("id < 0"), 5) == []
    assert cluster.seed_oversampled(same.where("id < 1"), 3) == [[1.0, 0.0]]


def test_seeds_do_not_depend_on_partitions(spark):
    pts = _points(spark)
    assert cluster.seed_oversampled(pts.repartition(7), 6) == cluster.seed_oversampled(pts.coalesce(1), 6)


def test_whole_trend_report(spark, tmp):
    news, s = tb.news(spark, SF), Settings(pattern=LETTER_WORD)
    pos = tb.lemma_dict(spark, SF)
    out, where = os.path.join(tmp, "trend"), os.path.join(tmp, "map")
    w = jobs.trend_report(news, "fr", out, spark.createDataFrame([("maison",)], "value string"), settings=s, pos_dict=pos,
                          drop_classes=["FUNC"], k=4, drop_ids=[0], map_path=where, map_shape=(2, 3))
    words = {r["word"]: (r["n"], r["n_texts"]) for r in w.collect()}
    assert words and "maison" not in words and min(map(len, words)) > 3
    units = {r["word"]: r["unit"] for r in spark.read.parquet(where).collect()}
    assert units.keys() == words.keys() and set(units.values()) <= set(range(6))
    empty = jobs.trend_report(news, "no such category", os.path.join(tmp, "none"), settings=s, k=3, drop_ids=[0], map_path=os.path.join(tmp, "nomap"))
    assert empty.count() == 0 and spark.read.parquet(os.path.join(tmp, "nomap")).count() == 0


def test_trend_report_of_a_file(spark, tmp):
    path = os.path.join(tmp, "in")
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write('title;text;category\n"Un; deux";"deux\n""trois""";fr\n;deux;fr\nx;autre;de\nseul;;fr\n')
    assert [r["content"] for r in scan_category_file(spark, path, "fr").orderBy("content").collect()] == ['Un; deux deux\n"trois"', "deux", "seul"]
    w = jobs.trend_report(read_category_table(spark, path), "fr", os.path.join(tmp, "out"), settings=Settings(pattern=LETTER_WORD))
    assert {r["word"]: (r["n"], r["n_texts"]) for r in w.collect()} == {"Un": (1, 1), "deux": (3, 2), "trois": (1, 1), "seul": (1, 1)}
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write("category;text;title\nfr;a;b\n")
    with pytest.raises(Exception):
        scan_category_file(spark, path, "fr").collect()       # columns in another order are told, not swapped


def test_audits_of_chosen_texts(spark):
    news = spark.createDataFrame([("1", 1, "2024-01-05 10:00:00", "день"), ("2", 2, "2024-01-05 11:00:00", "day"), ("3", 3, "2024-01-06 00:00:00", ""),
                                  ("4", 4, None, None), ("1", 5, "2024-01-07 00:00:00", "ночь")], "guid string, text_id int, date string, text string")
    def row(**k):
        return tuple(jobs.audit(news, **k).first())
    keys = spark.createDataFrame([("2",), ("3",), ("3",), ("9",), (None,)], "value string")
    assert row() == (5, 1, 2) and row(guid="1") == (2, 0, 0) and row(date="2024-01-05") == (2, 1, 0) and row(keys=keys) == (2, 1, 1)
    assert row(keys=keys.limit(0)) == (0, 0, 0)
    assert sorted((r["guid"], r["state"]) for r in jobs.audit_list(news, keys=keys).collect()) == [("2", "foreign"), ("3", "empty")]
    with pytest.raises(ValueError):
        jobs.audit(news, guid="1", date="2024-01-05")

"""Clustering queries over the embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from polarity.operators.cluster import (assign_clusters, kmeans, kmeans_ml, seed_weights, som,
                                        som_step, update_centroids, update_medians)
from polarity.plans import testbed as tb
from polarity.queries.registry import register, with_ctes

# start centroids: the lowest-id point of each label, cluster = label
START_SQL = ("SELECT label AS cluster, list_transform(arg_min(embedding, vec_id), lambda x: CAST(x AS DOUBLE)) AS c "
             "FROM embeddings GROUP BY label")
PTS_SQL = ("SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings")


def _points(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


def _start(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    return e.groupBy(F.col("label").alias("cluster")).agg(
        F.min_by(F.col("embedding").cast("array<double>"), F.col("vec_id")).alias("features"))


def _sq(x: str, c: str) -> str:
    return f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: ({x}[i] - {c}[i]) * ({x}[i] - {c}[i])))"


def _l1(x: str, c: str) -> str:
    return f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: abs({x}[i] - {c}[i])))"


def _assign_sql(dist: str) -> tuple[str, str]:
    return ("assigned", f"SELECT p.vec_id, p.x, arg_min(s.cluster, (({dist}), s.cluster)) AS cluster, "
                        f"min({dist}) AS best FROM pts p, start s GROUP BY p.vec_id, p.x")


def _explode_sql(src: str, key: str, n: str = "") -> str:
    ncol = f", {n}" if n else ""
    return (f"SELECT {key}{ncol}, CAST(i - 1 AS INTEGER) AS dim, round(c[i], 6) AS value FROM "
            f"(SELECT {key}{ncol}, c, unnest(range(1, len(c) + 1)) AS i FROM {src})")


def _explode(df, key, with_n=True):
    cols = [key] + (["n"] if with_n else [])
    return df.select(*cols, F.posexplode("features").alias("dim", "value")).select(
        *cols, F.col("dim").cast("int"), F.round("value", 6).alias("value"))


@register("assign_cluster", with_ctes(("pts", PTS_SQL), ("start", START_SQL),
                                      _assign_sql(_sq("p.x", "s.c")),
                                      select="SELECT vec_id, CAST(cluster AS INTEGER) AS cluster FROM assigned"))
def q_assign_cluster(spark, sf):
    """Nearest start centroid (squared Euclidean) per point."""
    return assign_clusters(_points(spark, sf), _start(spark, sf), "euclidean").select("vec_id", "cluster")


@register("assign_cluster_manhattan", with_ctes(("pts", PTS_SQL), ("start", START_SQL),
                                                _assign_sql(_l1("p.x", "s.c")),
                                                select="SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(best, 6) AS distance FROM assigned"))
def q_assign_cluster_manhattan(spark, sf):
    a = assign_clusters(_points(spark, sf), _start(spark, sf), "manhattan", with_distance=True)
    return a.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


LONG_SQL = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)"


@register("update_centroids", with_ctes(
    ("lab", "SELECT vec_id, label FROM embeddings"), ("long", LONG_SQL),
    ("n", "SELECT label, count(*) AS n FROM embeddings GROUP BY label"),
    select=("SELECT CAST(l.label AS INTEGER) AS cluster, n.n, g.dim, round(avg(g.v), 6) AS value "
            "FROM long g JOIN lab l ON g.vec_id = l.vec_id JOIN n ON n.label = l.label GROUP BY l.label, n.n, g.dim")))
def q_update_centroids(spark, sf):
    """Per-dimension means of the points of each label."""
    e = tb.table(spark, sf, "embeddings").select(
        F.col("label").cast("int").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))
    return _explode(update_centroids(e), "cluster")


@register("kmeans_step", with_ctes(
    ("pts", PTS_SQL), ("start", START_SQL), _assign_sql(_l1("p.x", "s.c")), ("long", LONG_SQL),
    ("n", "SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster"),
    select=("SELECT CAST(a.cluster AS INTEGER) AS cluster, n.n, g.dim, round(avg(g.v), 6) AS value "
            "FROM long g JOIN assigned a ON g.vec_id = a.vec_id JOIN n ON n.cluster = a.cluster "
            "GROUP BY a.cluster, n.n, g.dim")))
def q_kmeans_step(spark, sf):
    """M8, one Lloyd step with Manhattan distance from the start centroids."""
    a = assign_clusters(_points(spark, sf), _start(spark, sf), "manhattan")
    return _explode(update_centroids(a), "cluster")


@register("kmedians_step", with_ctes(
    ("pts", PTS_SQL), ("start", START_SQL), _assign_sql(_l1("p.x", "s.c")), ("long", LONG_SQL),
    ("n", "SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster"),
    select=("SELECT CAST(a.cluster AS INTEGER) AS cluster, n.n, g.dim, round(median(g.v), 6) AS value "
            "FROM long g JOIN assigned a ON g.vec_id = a.vec_id JOIN n ON n.cluster = a.cluster "
            "GROUP BY a.cluster, n.n, g.dim")))
def q_kmedians_step(spark, sf):
    """M8, one step with Manhattan distance whose update is the per-dimension median."""
    a = assign_clusters(_points(spark, sf), _start(spark, sf), "manhattan")
    return _explode(update_medians(a), "cluster")


@register("seed_weights",with_ctes(
    ("pts", PTS_SQL), ("start", START_SQL), _assign_sql(_sq("p.x", "s.c")),
    select="SELECT vec_id, round(sqrt(best), 6) AS weight, round(sqrt(best) / sum(sqrt(best)) OVER (), 9) AS prob FROM assigned"))
def q_seed_weights(spark, sf):
    """M9: draw weights (distance to the nearest chosen centroid) and draw probabilities."""
    w = seed_weights(_points(spark, sf), _start(spark, sf), "euclidean")
    total = w.select(F.sum("weight")).scalar()
    return w.select("vec_id", F.round("weight", 6).alias("weight"),
                    F.round(F.col("weight") / total, 9).alias("prob"))


SOM_ROWS, SOM_COLS, SOM_SIGMA = 2, 5, 1.0


def _som_sql() -> str:
    units = [(r, c) for r in range(SOM_ROWS) for c in range(SOM_COLS)]
    h = ", ".join(f"({u}, {b}, {math.exp(-((ru - rb) ** 2 + (cu - cb) ** 2) / (2 * SOM_SIGMA ** 2))!r})"
                  for u, (ru, cu) in enumerate(units) for b, (rb, cb) in enumerate(units))
    return with_ctes(
        ("pts", PTS_SQL), ("start", START_SQL), _assign_sql(_sq("p.x", "s.c")), ("long", LONG_SQL),
        ("per", "SELECT a.cluster AS bmu, g.dim, count(*) AS n, sum(g.v) AS s FROM long g "
                "JOIN assigned a ON g.vec_id = a.vec_id GROUP BY a.cluster, g.dim"),
        ("h", f"SELECT * FROM (VALUES {h}) t(unit, bmu, h)"),
        ("new", "SELECT h.unit, per.dim, sum(h.h * per.s) / sum(h.h * per.n) AS v "
                "FROM h JOIN per ON h.bmu = per.bmu GROUP BY h.unit, per.dim"),
        ("old", "SELECT cluster AS unit, CAST(i - 1 AS INTEGER) AS dim, c[i] AS v FROM start, range(1, 65) r(i)"),
        select=("SELECT CAST(o.unit AS INTEGER) AS unit, o.dim, round(coalesce(n.v, o.v), 6) AS value "
                "FROM old o LEFT JOIN new n ON n.unit = o.unit AND n.dim = o.dim"))


@register("som_step", _som_sql())
def q_som_step(spark, sf):
    """M11, one batch step of a 2 x 5 map (sigma 1) from the start codebook (unit = label).
    The codebook has 10 rows; it is collected as the loop would."""
    start = [list(r["features"]) for r in _start(spark, sf).orderBy("cluster").collect()]
    return _explode(som_step(_points(spark, sf), start, SOM_ROWS, SOM_COLS, SOM_SIGMA), "unit", with_n=False)


@register("kmeans")
def q_kmeans(spark, sf):
    """M8 with Spark ML (Euclidean, k-means|| seeding), k = 10."""
    p = _points(spark, sf)
    return kmeans_ml(p, 10, seed=7, key="vec_id")


@register("kmeans_manhattan")
def q_kmeans_manhattan(spark, sf):
    """M8 loop with Manhattan distance and k-means++ style seeding, k = 10."""
    out, _, _ = kmeans(_points(spark, sf), 10, "manhattan", seed=7, key="vec_id")
    return out


@register("som")
def q_som(spark, sf):
    """A 2 x 5 map."""
    out, _ = som(_points(spark, sf), SOM_ROWS, SOM_COLS, seed=7, key="vec_id")
    return out

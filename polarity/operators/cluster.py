"""k-means (Euclidean or Manhattan), seeding in few passes and a batch self-organising map.

Points are (id, features array<double>).  Centroids / codebooks have k rows (k is a parameter,
not data), so each iteration ships them to the tasks as one literal array and computes every
point's distances with array functions: no cross join, no per-point Python.  The per-cluster
sums come back through a partial aggregation (k rows), which is all the driver sees.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.functions.vecmath import manhattan, squared_euclidean
from polarity.operators.ids import dense_ids
from polarity.session import write_table

METRICS = ("euclidean", "manhattan")


def _dist(metric: str):
    if metric == "euclidean":
        return squared_euclidean  # same argmin as the distance, cheaper
    if metric == "manhattan":
        return manhattan
    raise ValueError(f"metric must be one of {METRICS}")


def _centroid_array(centroids) -> Column:
    """k centroids (list of lists, or a DataFrame of (cluster, features) with k rows as a scalar
    subquery) -> array<array<double>> column ordered by cluster id."""
    if isinstance(centroids, DataFrame):
        arr = centroids.select(F.sort_array(F.collect_list(F.struct("cluster", "features"))).alias("a"))
        return arr.select(F.transform("a", lambda s: s["features"].cast("array<double>"))).scalar()
    # one literal value, whatever k and the dimension
    return F.from_json(F.lit(json.dumps([[float(x) for x in c] for c in centroids])), "array<array<double>>")


def assign_clusters(points: DataFrame, centroids, metric: str = "euclidean",
                    features: str = "features", with_distance: bool = False) -> DataFrame:
    """Each point with the index (0-based, in centroid order) of its nearest centroid;
    ties go to the lower index."""
    dist = _dist(metric)
    # the centroid array is its own column: a subquery may not sit inside a lambda
    out = points.withColumn("_c", _centroid_array(centroids))
    out = out.withColumn("_d", F.transform("_c", lambda c: dist(F.col(features), c))).drop("_c")
    out = out.withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))
    if with_distance:
        best = F.array_min("_d")
        out = out.withColumn("distance", F.sqrt(best) if metric == "euclidean" else best)
    return out.drop("_d")


def update_centroids(assigned: DataFrame, features: str = "features") -> DataFrame:
    """Per-dimension mean of the points of each cluster: (cluster, n, features)."""
    v = assigned.select("cluster", array_to_vector(F.col(features)).alias("_v"))
    g = v.groupBy("cluster").agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.select("cluster", "n", vector_to_array("_m").alias("features"))


def update_medians(assigned: DataFrame, features: str = "features") -> DataFrame:
    """A17 for Manhattan distance: per-dimension median of the points of each cluster (the mean of the middle two for an even
    number): (cluster, n, features).  All values are ranked by (cluster, dimension, value) in one distributed
    sort and the middle ranks looked up, so no cluster is gathered in one task."""
    long = assigned.select("cluster", F.posexplode(F.col(features)).alias("dim", "value"))
    ranked = write_table(dense_ids(long, ["cluster", "dim", "value"], "_rank"), "median-ranks")
    span = ranked.groupBy("cluster", "dim").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    middle = span.select("cluster", "dim", "n", F.explode(F.array_distinct(F.array(
        F.col("_first") + F.floor((F.col("n") - 1) / 2), F.col("_first") + F.floor(F.col("n") / 2)))).alias("_rank"))
    value = (ranked.join(middle, ["cluster", "dim", "_rank"]).groupBy("cluster", "dim")
             .agg(F.avg("value").alias("value"), F.first("n").alias("n")))
    return value.groupBy("cluster").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "value")))["value"].alias("features"))


def _collect_centroids(df: DataFrame, k: int, old: list) -> list:
    rows = {r["cluster"]: list(r["features"]) for r in df.collect()}  # k rows at most
    return [rows.get(i, old[i]) for i in range(k)]  # an empty cluster keeps its centroid


def seed_weights(points: DataFrame, centroids, metric: str = "euclidean", power: int = 1,
                 features: str = "features") -> DataFrame:
    """M9 one step: each point's weight (distance to the nearest chosen centroid, ** power)."""
    a = assign_clusters(points, centroids, metric, features, with_distance=True)
    return a.withColumn("weight", F.pow(F.col("distance"), power))


def _uniform(seed, key: str) -> Column:
    """A number in (0, 1) from the seed and the key: the draw does not depend on the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def seed_oversampled(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 7, power: int = 1,
                     key: str = "id", features: str = "features", rounds: int = 5, factor: float = 2.0) -> list:
    """M9 in ``rounds`` + 2 passes, whatever k (k-means|| for any metric).

    Each round draws factor * k points at once, without replacement, with probability proportional to
    distance ** power from all candidates so far: the smallest -ln(u)/w, a bounded top list.  Every candidate is then weighted by
    the number of points nearest to it, and k of the at most 1 + rounds * factor * k weighted candidates are
    drawn on the driver, each as ``seed_centroids`` draws them.  Fewer than k distinct points give as many centroids; none, none."""
    first = points.select(F.min_by(F.col(features), _uniform(seed, key)).alias("f")).first()["f"]
    if first is None:
        return []
    cents, n = [list(first)], max(int(math.ceil(factor * k)), 1)
    for r in range(1, rounds + 1):
        w = seed_weights(points, cents, metric, power, features).where(F.col("weight") > 0)
        race = w.select(features, F.col(key), (-F.log(_uniform(seed + r, key)) / F.col("weight")).alias("_race"))
        drawn = race.orderBy("_race", key).limit(n).collect()           # n rows at most
        cents += [list(x) for x in dict.fromkeys(tuple(row[features]) for row in drawn)]
        if not drawn:       # every point is a candidate
            break
    mass = np.zeros(len(cents))
    for row in assign_clusters(points, cents, metric, features).groupBy("cluster").count().collect():
        mass[row["cluster"]] = row["count"]
    return [cents[i] for i in _draw(np.asarray(cents, float), mass, k, metric, power, seed)]


def _draw(cands: np.ndarray, mass: np.ndarray, k: int, metric: str, power: int, seed: int) -> list[int]:
    """k of the weighted candidates, the first by mass, the next by mass * distance ** power."""
    rng = np.random.default_rng(seed)
    weight, near, chosen = mass.astype(float), np.full(len(cands), np.inf), []
    while len(chosen) < k and weight.sum() > 0:
        i = int(rng.choice(len(cands), p=weight / weight.sum()))
        chosen.append(i)
        diff = cands - cands[i]
        d = np.sqrt((diff * diff).sum(1)) if metric == "euclidean" else np.abs(diff).sum(1)
        near = np.minimum(near, d)
        weight = mass * near ** power
    return chosen


def seed_centroids(points: DataFrame, k: int, metric: str = "euclidean", seed: int = 7,
                   power: int = 1, key: str = "id", features: str = "features") -> list:
    """M9: first centroid a uniformly drawn point, each next one drawn with probability
    proportional to weight (distance to the nearest chosen centroid ** power).  One weighted
    draw = min over points of -ln(u)/w (exponential race), a plain aggregate: k passes."""
    first = (points.withColumn("_u", _uniform(seed, key))
             .select(F.min_by(F.col(features), F.col("_u")).alias("f")).first()["f"])
    if first is None:       # no points
        return []
    cents = [list(first)]
    for i in range(1, k):
        w = seed_weights(points, cents, metric, power, features).where(F.col("weight") > 0)
        w = w.withColumn("_race", -F.log(_uniform(seed + i, key)) / F.col("weight"))
        nxt = w.select(F.min_by(F.col(features), F.col("_race")).alias("f")).first()["f"]
        if nxt is None:  # fewer distinct points than k
            break
        cents.append(list(nxt))
    return cents


def kmeans(points: DataFrame, k: int, metric: str = "euclidean", max_iter: int = 100,
           seed: int = 7, init=None, tol: float = 0.0, key: str = "id",
           features: str = "features", update: str = "mean") -> tuple[DataFrame, list, int]:
    """M8: Lloyd iterations until the assignment no longer changes (centroids stop moving); a run
    that is cut off by max_iter before that warns.  ``update``: mean, or median (which is what lowers Manhattan distances).
    Returns (assignments (key, cluster), centroids, iterations); no points have no assignments and no centroids."""
    if update not in ("mean", "median"):
        raise ValueError("update must be mean or median")
    moved_to = update_centroids if update == "mean" else update_medians
    source = points.select(key, F.col(features).cast("array<double>").alias(features))
    pts = source.persist()
    cents = [list(map(float, c)) for c in init] if init is not None else \
        seed_oversampled(pts, k, metric, seed, 1, key, features)
    k = len(cents)
    if not k:
        pts.unpersist()
        return source.select(key, F.lit(None).cast("int").alias("cluster")), [], 0
    it = 0
    for it in range(1, max_iter + 1):
        new = _collect_centroids(moved_to(assign_clusters(pts, cents, metric, features), features), k, cents)
        moved = max(float(np.max(np.abs(np.asarray(a) - np.asarray(b)))) for a, b in zip(new, cents))
        cents = new
        if moved <= tol:
            break
    else:
        warnings.warn(f"k-means: centroids still move after max_iter={max_iter} rounds", stacklevel=2)
    pts.unpersist()
    return assign_clusters(source, cents, metric, features).select(key, "cluster"), cents, it


def kmeans_ml(points: DataFrame, k: int, max_iter: int = 100, seed: int = 7, key: str = "id",
              features: str = "features") -> DataFrame:
    """M8 for Euclidean distance with Spark ML (k-means|| seeding): (key, cluster)."""
    from pyspark.ml.clustering import KMeans
    v = points.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    if v.isEmpty():
        return v.select(key, F.lit(None).cast("int").alias("cluster"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).select(key, F.col("cluster").cast("int"))


# ---------------------------------------------------------------- self-organising map

def _kernel(n: int, sigma: float) -> np.ndarray:
    d = np.subtract.outer(np.arange(n), np.arange(n))
    return np.exp(-(d * d) / (2 * sigma * sigma))


def som_step(points: DataFrame, codebook: list, rows: int, cols: int, sigma: float,
             features: str = "features") -> DataFrame:
    """One batch-SOM step: best unit per point (J8), per-unit sums (rows x cols rows come back, as
    in k-means), then each unit's new weights = sum_b h(u,b) S_b / sum_b h(u,b) n_b with a Gaussian
    h of the grid distance, applied along the rows and then along the columns.  Returns (unit,
    features); a unit with no mass keeps its weights."""
    a = assign_clusters(points, codebook, "euclidean", features)
    old = np.array(codebook, float)
    mass = np.zeros((rows * cols, old.shape[1] + 1))
    for r in update_centroids(a, features).collect():
        mass[r["cluster"]] = [r["n"], *(np.array(r["features"], float) * r["n"])]
    spread = np.einsum("ir,jc,rcd->ijd", _kernel(rows, sigma), _kernel(cols, sigma), mass.reshape(rows, cols, -1)).reshape(mass.shape)
    new = np.where(spread[:, :1] > 0, spread[:, 1:] / np.where(spread[:, :1] > 0, spread[:, :1], 1.0), old)
    return points.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(new)], "unit int, features array<double>")


def som(points: DataFrame, rows: int, cols: int, iters: int = 10, seed: int = 7,
        sigma0: float | None = None, sigma1: float = 0.5, key: str = "id",
        features: str = "features") -> tuple[DataFrame, list]:
    """Batch SOM with a shrinking neighbourhood.  Start codebook: oversampled seeds.
    Returns (assignments (key, unit), codebook)."""
    source = points.select(key, F.col(features).cast("array<double>").alias(features))
    pts = source.persist()
    k = rows * cols
    code = seed_oversampled(pts, k, "euclidean", seed, 2, key, features)
    if not code:            # no points: no assignments, no codebook
        pts.unpersist()
        return source.select(key, F.lit(None).cast("int").alias("unit")), []
    while len(code) < k:
        code.append(list(code[-1]))
    s0 = sigma0 if sigma0 is not None else max(rows, cols) / 2.0
    for t in range(iters):
        sigma = s0 * (sigma1 / s0) ** (t / max(iters - 1, 1))
        rows_ = som_step(pts, code, rows, cols, sigma, features).collect()  # k rows
        code = [list(r["features"]) for r in sorted(rows_, key=lambda r: r["unit"])]
    pts.unpersist()
    return assign_clusters(source, code, "euclidean", features).select(key, F.col("cluster").alias("unit")), code

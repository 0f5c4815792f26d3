"""Scores by key (K8, J6): a base table bucketed by key, and the batches written since.

``path/batch=N`` holds the scores of batch N.  ``compact`` folds all of them into ``path-base``, one row a key in a fixed
number of hash buckets, so a read exchanges the texts and the few open batches, never the base.  The base's folder
names the newest batch in it and its number of buckets; it is published by one rename.  Batches that the base
before it held are removed, so a reader that has begun on the old base finds its batches.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.session import path_exists, remove_path
from polarity.sources.atomic import _children, _publish

_BASE = re.compile(r"upto-(\d{12})-buckets-(\d+)$")
_BATCH = re.compile(r"batch=(\d+)$")


def _bases(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    return sorted((int(m[1]), int(m[2])) for m in map(_BASE.match, _children(spark, f"{path}-base")) if m)


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that are still there as batches."""
    return sorted(int(m[1]) for m in map(_BATCH.match, _children(spark, path)) if m)


def next_batch(spark: SparkSession, path: str) -> int:
    return max([-1, *batches(spark, path), *[upto for upto, _ in _bases(spark, path)]]) + 1


def _folder(path: str, upto: int, buckets: int) -> str:
    return f"{path}-base/upto-{upto:012d}-buckets-{buckets}"


def _bucketed(spark: SparkSession, folder: str, key: str, buckets: int) -> DataFrame:
    """A folder of bucket files as a table of the session's catalog, which is where Spark keeps what buckets are."""
    name = "polarity_base_" + hashlib.md5(folder.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def read_base(spark: SparkSession, path: str, key: str = "guid") -> tuple[DataFrame | None, int]:
    """(base or None, newest batch in it or -1)."""
    found = _bases(spark, path)
    if not found:
        return None, -1
    return _bucketed(spark, _folder(path, *found[-1]), key, found[-1][1]), found[-1][0]


def read_open(spark: SparkSession, path: str, after: int, key: str = "guid", label: str = "label") -> DataFrame | None:
    """One label per key of the batches after ``after`` (the last batch wins, then the largest label); None without any."""
    todo = [b for b in batches(spark, path) if b > after]
    if not todo:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in todo])
    return rows.groupBy(key).agg(F.max_by(label, F.struct("batch", label)).alias(label))


def current(spark: SparkSession, path: str, key: str = "guid", label: str = "label") -> DataFrame | None:
    """All scores, one per key: (key, label); None if none was ever written."""
    base, upto = read_base(spark, path, key)
    new = read_open(spark, path, upto, key, label)
    if base is None or new is None:
        return new if base is None else base.select(key, label)
    both = base.select(key, F.col(label).alias("_old")).join(new, key, "full")
    return both.select(key, F.coalesce(label, "_old").alias(label))


def apply_scores(texts: DataFrame, path: str, key: str = "guid", score_col: str = "temote", label: str = "label") -> DataFrame:
    """``texts`` with all scores written under ``path``: the newest wins, a text without one keeps its own."""
    spark = texts.sparkSession
    base, upto = read_base(spark, path, key)
    new = read_open(spark, path, upto, key, label)
    out, found = texts, []
    for name, scores in (("_new", new), ("_base", base)):
        if scores is not None:
            out = out.join(scores.select(key, F.col(label).alias(name)), key, "left")
            found.append(name)
    if not found:
        return texts
    value = F.coalesce(*found, score_col).cast(texts.schema[score_col].dataType).alias(score_col)
    return out.select(*[value if c == score_col else F.col(c) for c in texts.columns])


def compact(spark: SparkSession, path: str, key: str = "guid", label: str = "label", buckets: int | None = None) -> None:
    """Fold the open batches into a new base.  ``buckets`` (default: those of the base, for a first one the session's
    shuffle partitions) is part of the base's name, so a session with other settings reads it right.  Stopped at any step,
    the old base and its batches are whole; nothing open: nothing is done."""
    _, upto = read_base(spark, path, key)
    todo = [b for b in batches(spark, path) if b > upto]
    if not todo:
        return
    found = _bases(spark, path)
    n = buckets or (found[-1][1] if found else int(spark.conf.get("spark.sql.shuffle.partitions")))
    new, name = f"{path}-base/_new-{uuid.uuid4().hex[:12]}", f"polarity_new_{uuid.uuid4().hex}"
    rows = current(spark, path, key, label)
    rows.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", new).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")                     # the files stay: the table is external
    _publish(spark, new, _folder(path, todo[-1], n))
    for old in found[:-1]:
        remove_path(spark, _folder(path, *old))
    for b in batches(spark, path):
        if b <= upto and path_exists(spark, f"{path}/batch={b}"):
            remove_path(spark, f"{path}/batch={b}")
    for stale in _children(spark, f"{path}-base"):
        if stale.startswith("_new-"):
            remove_path(spark, f"{path}-base/{stale}")

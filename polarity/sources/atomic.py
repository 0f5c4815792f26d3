"""Tables that are replaced whole: a reader gets the old table or the new one, never none.

A table is a folder of versions.  A new version is written beside the old ones under a name that no reader looks at,
and one file-system rename gives it its number; the reader takes the highest number.  A write that is stopped at
any step leaves the old version in place (and a folder that the next write removes).  The version before stays, for
readers that have begun on it.  On a store whose rename is a copy (some object stores) the last step is not atomic.

A folder that Spark wrote on its own (no versions in it) is read as it is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT = 2
_VERSION = re.compile(r"v-(\d{12})$")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(m[1]) for m in map(_VERSION.match, _children(spark, path)) if m)


def _folder(path: str, version: int) -> str:
    return f"{path}/v-{version:012d}"


def current_path(spark: SparkSession, path: str) -> str | None:
    """The folder to read now; None if there is no table yet."""
    found = versions(spark, path)
    if found:
        return _folder(path, found[-1])
    plain = [c for c in _children(spark, path) if not c.startswith("_new-")]
    return path if plain else None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's newest version; None if there is none."""
    now = current_path(spark, path)
    return None if now is None else spark.read.parquet(now)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` (which may read the table itself) as the next version and return it, read back."""
    spark = df.sparkSession
    new = f"{path}/_new-{uuid.uuid4().hex[:12]}"
    df.write.parquet(new)
    while True:
        version = (versions(spark, path) or [0])[-1] + 1
        if _publish(spark, new, _folder(path, version)):
            break
    _clean(spark, path, version)
    return spark.read.parquet(_folder(path, version))


def _publish(spark: SparkSession, new: str, folder: str) -> bool:
    """One rename; False if another writer has taken the number."""
    fs, source = _fs(spark, new)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return not fs.exists(target) and fs.rename(source, target)


def _clean(spark: SparkSession, path: str, version: int) -> None:
    for old in versions(spark, path):
        if old <= version - KEPT:
            fs, target = _fs(spark, _folder(path, old))
            fs.delete(target, True)
    for name in _children(spark, path):
        if name.startswith("_new-"):
            fs, target = _fs(spark, f"{path}/{name}")
            fs.delete(target, True)

"""Session helpers: building a local session and locating the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "polarity",
                  extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint dir).
    Only a local-mode session without one gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="polarity-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # an Arrow batch stands in the JVM's direct memory, in the worker and in what the worker makes of it
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict | None = None):
    """The session with other settings (those for intermediate tables by default), put back at the end."""
    wanted = _WRITING if wanted is None else wanted
    before = {k: spark.conf.get(k, None) for k in wanted}         # null when it has its default
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage by writing a parquet table into the shared folder and reading it back:
    columnar and compressed, so later scans read only the columns they need.  The shuffle files of the
    write are removed with it: the table stands in for them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with settings(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store the session reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path in whatever store the session reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


PARTITION_BYTES = 4 << 20      # of the input's files, for one task that makes n-grams


def partitions_for(*frames: DataFrame) -> int:
    """Number of partitions in proportion to the files that the frames read, the session's number at least: a task's
    share stays the same however large the input is."""
    spark = frames[0].sparkSession
    files = {f for df in frames for f in df.inputFiles()}
    read = sum(path_bytes(spark, f) for f in files)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read // PARTITION_BYTES))


def packed_partitions(*frames: DataFrame) -> int:
    """As ``partitions_for`` for rows that are packed: half as many, so that what a task sends to one is worth packing."""
    least = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-partitions_for(*frames) // 2))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's file system layer (any store the session reads)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table_path(df: DataFrame) -> str:
    """The folder of a table written by ``write_table`` (for ``remove_path``)."""
    return os.path.dirname(df.inputFiles()[0])

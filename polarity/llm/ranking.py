"""Positions of rows within groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarity.session import write_table

_LOW_BITS = (1 << 33) - 1


def rank_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` = 0, 1, ... within each value of ``group`` (null is a value too)
    following ``order``.

    Rows are dealt by range over (group, order), so a large group spans many tasks; their places
    are fixed by a written table, and the runs of a group (one a task) are summed up.  The
    runs' table has a row for each group and task at most.  ``df`` should be a stored table:
    dealing by range reads it twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *map(F.col, order)]
    placed = write_table(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_run": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_LOW_BITS))})
    runs = placed.groupBy(group, "_run").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = write_table(runs.select(F.col(group).alias("_group"), F.col("_run").alias("_of"), "_first",
                                   F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "runs")
    out = placed.join(runs, placed[group].eqNullSafe(runs["_group"]) & (placed["_run"] == runs["_of"]))
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))

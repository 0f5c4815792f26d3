"""Dense ids 1..N in a sort order without funnelling rows through one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarity.session import write_table

_LOW_BITS = (1 << 33) - 1


def dense_ids(df: DataFrame, order_cols, name: str = "id", start: int = 1,
              partitions: int | None = None, ranged: bool = False) -> DataFrame:
    """Attach ``name`` = start, start+1, ... following ``order_cols`` (should be a unique key).

    Range-partition + sort within partitions, tag rows with monotonically_increasing_id
    (partition index in the high bits, position in the low bits), write the tagged rows as a
    table in the shared folder so the tags are fixed, then add per-partition offsets (counted
    from the tag column alone).  The offsets table has one row per partition, so
    broadcasting it is bounded by the partition count, not by the data.  ``ranged``: the rows lie
    in ranges of ``order_cols`` already.
    """
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    spark = df.sparkSession
    if not ranged:
        df = df.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order_cols)
    tagged = (df
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = write_table(tagged, "dense-ids", "zstd")
    pid = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), pid == F.col("_pid"))
    rank = F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + F.lit(start)
    return out.select(rank.cast("bigint").alias(name), *[F.col(c) for c in df.columns])

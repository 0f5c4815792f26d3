"""Exact dedup: stateful streaming over digests, full bytes checked on hits.

Documents enter a stream as (digest, identifier, content locator).  The stream's keyed state,
disk-backed (RocksDB) and without expiry, holds for each digest the retained identifier, its
locator (file and row of the text) and the group's size.  The arrivals come in about BATCHES
micro-batches whatever their size, so that later ones meet what earlier ones retained; a micro-batch
is combined in its tasks
before it reaches the state, so a digest that a third of all documents share arrives as one
row a task.  Every hit is then checked byte for byte against the text that its state entry
locates; texts that share a digest but differ are regrouped by their full bytes.

Only DataFrame operations run here.  Defined results: null text counts as empty; of equal texts
the row with the largest identifier stays (null lowest, further ties by locator), so exactly one
row of a group stays also when identifiers repeat; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.llm.common import located, text_or_empty
from polarity.session import path_bytes, remove_path, scratch_path, settings, table_path, write_table

BATCHES = 4

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # many small stores: no megabytes of preallocated log files for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def retain(spark: SparkSession, arrivals_path: str, schema, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Run all arrivals through the keyed state; one row per digest: keep (id, file, row), n.
    Without a bound on a micro-batch's bytes it is the ``BATCHES``-th part of all, in whole files."""
    if max_bytes_per_trigger is None:
        max_bytes_per_trigger = max(1, path_bytes(spark, arrivals_path) // BATCHES)
    state = scratch_path(spark, "dedup-state")
    with settings(spark, _STATE):
        (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger))
         .parquet(arrivals_path)
         .groupBy("digest")
         .agg(F.max(F.struct("id", "file", "row")), F.count(F.lit(1)))
         .writeStream.format("noop").outputMode("update")
         .option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
        kept = spark.read.format("statestore").load(state)
        keep, n = kept.schema["value"].dataType.names
        # written while the state's provider is set: its reader looks the setting up when it runs
        out = write_table(kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep}").alias("keep"),
                                      F.col(f"value.{n}").alias("n")), "dedup-keep")
    remove_path(spark, state)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] | None = None,
                 max_bytes_per_trigger: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, sha256, file, row.

    ``digest`` maps the text column to the state's key (default: SHA-256); any digest gives the
    same groups, a weak one only more full-byte regrouping.
    """
    spark = docs.sparkSession
    placed = located(docs)
    file, row = placed.columns[-2:]
    text = text_or_empty(text_col)
    sha = F.sha2(text, 256)
    arrivals = write_table(
        placed.select(F.col(id_col).alias("id"), sha.alias("sha256"),
                      (digest(text) if digest else F.unhex(sha)).alias("digest"),
                      F.col(file).alias("file"), F.col(row).alias("row")), "dedup-arrivals")
    state = retain(spark, table_path(arrivals), arrivals.schema, max_bytes_per_trigger)
    whole = write_table(
        arrivals.join(state, "digest")
        .select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
                "sha256", "digest", "file", "row"), "dedup-groups")
    # Full bytes of all rows in groups: hits against the text that their state entry locates.
    group = whole.filter("group_size > 1")
    texts = (placed.select(text.alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
             .join(group, ["file", "row"]))
    stay = texts.filter("kept").select("digest", F.col("text").alias("keep_text"))
    # no distinct() here: it would hold the join to one task for each digest
    differ = write_table(texts.filter("not kept").join(stay, "digest").filter("text != keep_text").select("digest"),
                         "dedup-differ")
    for t in (state, arrivals):
        remove_path(spark, table_path(t))
    if differ.isEmpty():
        return whole.drop("digest")
    again = texts.join(differ, "digest", "left_semi")
    best = (again.groupBy("digest", "text")
            .agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")))
    mended = (again.join(best, ["digest", "text"])
              .select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                      ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
                      "sha256", "file", "row"))
    return whole.join(differ, "digest", "left_anti").drop("digest").unionByName(mended)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns as they were."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    stay = (exact_groups(placed, id_col, text_col).filter("kept")
            .select(F.col("file").alias(file), F.col("row").alias(row)))
    return placed.join(stay, [file, row], "left_semi").select(*[f"`{c}`" for c in docs.columns])

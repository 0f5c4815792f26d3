"""The number of shards belongs to a checkpoint, not to the machine."""

import os

import pytest
from pyspark.sql import functions as F

from polarity.sources.files import read_messages
from polarity.streaming.batches import SHARDS, batch_by_count
from polarity.streaming.stream import fixed_shards


def test_number_is_stored_with_the_first_run(spark, tmp):
    ck = os.path.join(tmp, "ck")
    assert fixed_shards(spark, ck, 5) == 5 and fixed_shards(spark, ck) == 5 and fixed_shards(spark, ck, 5) == 5
    with pytest.raises(ValueError):
        fixed_shards(spark, ck, 6)
    assert fixed_shards(spark, os.path.join(tmp, "other")) == SHARDS


def test_older_checkpoint_must_be_told(spark, tmp):
    ck = os.path.join(tmp, "ck")
    os.makedirs(os.path.join(ck, "offsets"))
    open(os.path.join(ck, "offsets", "0"), "w").close()
    with pytest.raises(ValueError):
        fixed_shards(spark, ck)
    assert fixed_shards(spark, ck, 8) == 8 and fixed_shards(spark, ck) == 8


def test_restart_on_another_cluster_releases_waiting_rows(spark, tmp, monkeypatch):
    src, ck, out = (os.path.join(tmp, n) for n in ("in", "ck", "out"))
    os.makedirs(src)

    def run(first, n, parallelism):
        with open(os.path.join(src, f"{first}.txt"), "w") as f:
            f.writelines(f"id{i}\tтекст\n" for i in range(first, first + n))
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", parallelism)
        (batch_by_count(read_messages(spark, "text", src), 10, fixed_shards(spark, ck)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination())
    run(0, 60, 3)
    run(60, 2000, 7)
    rows = spark.read.parquet(out)
    sizes = rows.groupBy("shard", "batch_no").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [10] and rows.count() == rows.select("id").distinct().count()
    early = {r["id"] for r in rows.where(F.substring("id", 3, 9).cast("int") < 60).collect()}
    assert len(early) == 60         # every row that waited came out once its shard was full

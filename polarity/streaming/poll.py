"""Polling a table for new rows as a stream (T4): the offset is the (date, key) of the last row handed out.

A clock of Spark's own (one micro-batch a tick) drives the query; what a micro-batch holds is decided by positions.
Batch n takes the unscored rows behind the last stored position, up to a new one that is stored under n by one rename
before any row is handed out.  A batch that is run again after a failure finds its position and takes the same range,
so rows come once in each batch that ends, none is missed, and a day with more rows than a batch goes on in the next.

As with any position by date, a row that is inserted later with a date behind the position is not seen.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.sources.atomic import _children, _fs, _publish
from polarity.sources.tables import limited

KEPT = 2            # positions that stay: that of the batch that may run again, and the one before it
_POSITION = re.compile(r"p-(\d{12})$")


def _positions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(m[1]) for m in map(_POSITION.match, _children(spark, folder)) if m)


def _load(spark: SparkSession, folder: str, batch: int) -> tuple:
    return tuple(spark.read.parquet(f"{folder}/p-{batch:012d}").first())


def _store(spark: SparkSession, folder: str, batch: int, position: tuple, rows: DataFrame, date: str, key: str) -> None:
    new = f"{folder}/_new-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([position], rows.select(date, key).schema).write.parquet(new)
    if not _publish(spark, new, f"{folder}/p-{batch:012d}"):
        raise RuntimeError(f"another stream polls with {folder}")
    for old in _positions(spark, folder)[:-KEPT]:
        fs, target = _fs(spark, f"{folder}/p-{old:012d}")
        fs.delete(target, True)


def _behind(rows: DataFrame, position: tuple | None, date: str, key: str, back: bool = False) -> DataFrame:
    """Rows behind a position (``back``: up to it); rows without a date or key come first.  The date on its own is
    compared too, as that is what a source can prune by."""
    if position is None:
        return rows
    at = F.struct(F.lit(position[0]).cast(rows.schema[date].dataType).alias(date), F.lit(position[1]).cast(rows.schema[key].dataType).alias(key))
    row, day = F.struct(date, key), F.lit(position[0]).cast(rows.schema[date].dataType)
    if back:
        return rows.where(row <= at)
    return rows.where(row > at if position[0] is None else (row > at) & (F.col(date) >= day))


def next_rows(news: DataFrame, folder: str, batch: int, limit: int | None = None, score: str = "temote",
              date: str = "date", key: str = "text_id") -> DataFrame | None:
    """The unscored rows of batch ``batch``, None if there are none: those of its stored position if it has run before, else
    all behind the last position, ``limit`` of them in (date, key) order (rows of one (date, key) stay together)."""
    spark, rows = news.sparkSession, news.where(F.col(score).isNull())
    stored = _positions(spark, folder)
    earlier = [n for n in stored if n < batch]
    rows = _behind(rows, _load(spark, folder, earlier[-1]) if earlier else None, date, key)
    if batch in stored:
        end = _load(spark, folder, batch)
    else:
        last = limited(rows.select(date, key), [date, key], limit).agg(F.max(F.struct(date, key)).alias("m")).first()["m"]
        if last is None:
            return None
        end = tuple(last)
        _store(spark, folder, batch, end, rows, date, key)
    return _behind(rows, end, date, key, back=True)


def poll_stream(spark: SparkSession, read_news: Callable[[SparkSession], DataFrame], handle: Callable[[DataFrame, int], None],
                checkpoint: str, limit: int | None = None, trigger: dict | None = None, score: str = "temote",
                date: str = "date", key: str = "text_id"):
    """T4: hand the new unscored rows to ``handle(rows, batch number)`` at every tick of ``trigger`` (every minute if none
    is given).  ``read_news`` is called for every batch, so that it sees what the table holds now.  A tick without new
    rows calls nothing.  ``handle`` may see a batch again after a failure and must write by batch number.
    Returns the started StreamingQuery."""
    def tick(clock: DataFrame, batch: int) -> None:
        rows = next_rows(read_news(clock.sparkSession), f"{checkpoint}/positions", batch, limit, score, date, key)
        if rows is not None:
            handle(rows, batch)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return (clock.writeStream.option("checkpointLocation", f"{checkpoint}/clock").foreachBatch(tick)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def poll_available(spark: SparkSession, read_news: Callable[[SparkSession], DataFrame], handle: Callable[[DataFrame, int], None],
                   checkpoint: str, limit: int | None = None, **columns) -> int:
    """T4 until a tick finds nothing new; returns the number of batches handed out.  The checkpoint is that of
    ``poll_stream``, which may go on with it."""
    handed = 0

    def count(rows: DataFrame, batch: int) -> None:
        nonlocal handed
        handle(rows, batch)
        handed += 1

    while True:
        before = handed
        poll_stream(spark, read_news, count, checkpoint, limit, {"availableNow": True}, **columns).awaitTermination()
        if handed == before:
            return handed


def score_polled(model, dictionary: DataFrame, settings, scores_path: str, lemma_dict: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A ``handle`` that scores every batch as P8 does: scores and errors to a folder of the batch number, of rows with one
    guid the last by text_id counts."""
    from polarity.streaming.stream import score_batch

    def handle(rows: DataFrame, batch: int) -> None:
        score_batch(rows.select(F.col("guid").alias("id"), "text", F.col("text_id").alias("seq")), batch, model, dictionary, settings,
                    scores_path, lemma_dict)
    return handle

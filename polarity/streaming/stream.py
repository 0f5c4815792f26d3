"""Structured Streaming: message intake, count-triggered batches, scoring with write-back
(T1-T5, P8).

The reference cleans messages as they come, buffers them in a file and scores the buffer once it holds 100
texts.  Here the buffer is streaming state per shard (``streaming.batches``): cleaned rows wait in state until
``threshold`` of them are there, a full batch is emitted, the rest stays; a time-out flushes a short
tail, and so does the end of a run over what is available.  State per shard never exceeds
threshold - 1 rows after a trigger.
"""

from __future__ import annotations

import os
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.config import CYRILLIC_WORD, SCORING_BATCH, Settings
from polarity.functions.text import clean, text_state
from polarity.session import remove_path, table_path, write_table
from polarity.sources import deltas
from polarity.sources.atomic import _children, _fs
from polarity.streaming.batches import SHARDS, batch_by_count

TIMEOUT_MS = 60_000     # how long a message of a continuous run waits for a full batch


def intake(messages: DataFrame, pattern: str = CYRILLIC_WORD) -> DataFrame:
    """Parsed messages (id, text) with the cleaned text and its state."""
    return messages.select("id", "text", clean("text", pattern).alias("clean_text"),
                           text_state("text", pattern).alias("state"))


def fixed_shards(spark: SparkSession, checkpoint: str, shards: int | None = None) -> int:
    """The number of shards of a checkpoint, stored beside it by its first run.  A restart takes the stored number; asking
    for another one is an error, and so is a checkpoint that has run without a stored number unless the number is given."""
    stored = [int(c) for c in _children(spark, f"{checkpoint}/shards") if c.isdigit()]
    if stored:
        if shards not in (None, stored[0]):
            raise ValueError(f"the checkpoint has {stored[0]} shards, {shards} were asked for")
        return stored[0]
    if shards is None and _children(spark, f"{checkpoint}/offsets"):
        raise ValueError("the checkpoint has run without a stored number of shards: give the number it ran with")
    fs, folder = _fs(spark, f"{checkpoint}/shards/{shards or SHARDS}")
    fs.mkdirs(folder)
    return shards or SHARDS


def score_batch(batch: DataFrame, batch_id: int, model, dictionary: DataFrame, settings: Settings,
                scores_path: str, lemma_dict: DataFrame | None = None) -> None:
    """T3 + T5: lemmatise, score and write one micro-batch of cleaned texts (``intake``; a batch without a state
    is cleaned here): scores to ``scores_path/batch=<id>``, texts without words to
    ``<scores_path>-errors/batch=<id>``.  Of rows with one key the last that came is scored; the folders are
    overwritten, so a replayed batch (after a failure) leaves exactly one copy."""
    from polarity.operators.scoring import last_rows
    from polarity.operators.svm import predict
    from polarity.operators.vectors import score_space
    from polarity.plans.jobs import prepare
    if "state" not in batch.columns:
        batch = batch.withColumns({"text": clean("text", settings.pattern), "state": text_state("text", settings.pattern)})
    texts = write_table(last_rows(batch.select(F.col("id").alias("guid"), "text", "state", "seq"), "guid", ["seq"]).drop("seq"), "stream-batch")
    good, bad = texts.where("state = 'ok'").drop("state"), texts.where("state <> 'ok'").select("guid", F.col("state").alias("reason"))
    bad.write.mode("overwrite").parquet(os.path.join(f"{scores_path}-errors", f"batch={batch_id}"))
    ready = prepare(good, lemma_dict, settings, "guid").select("guid", F.col("lemma_text").alias("text"))
    pred = predict(model, score_space(ready, dictionary, settings), "guid")
    pred.write.mode("overwrite").parquet(os.path.join(scores_path, f"batch={batch_id}"))
    remove_path(texts.sparkSession, table_path(texts))


def score_stream(stream: DataFrame, model, dictionary: DataFrame, settings: Settings,
                 scores_path: str, checkpoint: str, threshold: int = SCORING_BATCH,
                 shards: int | None = None, timeout_ms: int | None = None, trigger: dict | None = None,
                 lemma_dict: DataFrame | None = None):
    """Messages -> intake (T1: cleaned as they come, with their state) -> count-triggered batches of cleaned texts ->
    lemmatised as in the batch job -> scores written per micro-batch.  The number of shards belongs to the
    checkpoint (``fixed_shards``).  A run over what is available flushes its tail, so every message is scored, and takes no
    time-out; in a continuous run a message waits ``timeout_ms`` at most (``TIMEOUT_MS`` if none is given).
    Returns the started StreamingQuery."""
    trigger = trigger or {"availableNow": True}
    ends = bool(trigger.get("availableNow") or trigger.get("once"))
    if ends and timeout_ms is not None:
        raise ValueError("a run over what is available flushes its tail: it takes no time-out")
    shards = fixed_shards(stream.sparkSession, checkpoint, shards)
    cleaned = intake(stream, settings.pattern).select("id", F.col("clean_text").alias("text"), "state")
    batches = batch_by_count(cleaned, threshold, shards, None if ends else timeout_ms or TIMEOUT_MS, flush=ends, carry=("state",))
    w = (batches.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: score_batch(df, bid, model, dictionary, settings, scores_path, lemma_dict)))
    return w.trigger(**trigger).start()


def current_scores(spark, scores_path: str) -> DataFrame:
    """All streamed scores, one per key (the latest batch wins; ``deltas.compact`` folds old batches)."""
    return deltas.current(spark, scores_path)


def written_back(news: DataFrame, scores_path: str) -> DataFrame:
    """K8 of the stream: the texts with their streamed scores applied by key."""
    return deltas.apply_scores(news, scores_path)


def poll_new(news: DataFrame, watermark_path: str, score: str = "temote", date: str = "date") -> DataFrame:
    """T4 (batch form): unscored rows at or after the stored watermark; nothing stored -> all."""
    from polarity.sources.sinks import load_watermark
    from polarity.sources.tables import scan_unscored
    wm = load_watermark(news.sparkSession, watermark_path)
    return scan_unscored(news, wm, score, date)

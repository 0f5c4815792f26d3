"""Count-triggered batches (T2): rows wait in keyed state until ``threshold`` of them are there.

A shard's waiting rows are a list state, appended to as rows come and read only when a batch is due; a small value
state holds their number, so a micro-batch that fills nothing costs no more than its own rows.  A processing-time timer,
set when the first row begins to wait and stored with the state, releases a short tail, also of a shard that gets no
more rows and after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from polarity.config import SCORING_BATCH

SHARDS = 32         # of a new checkpoint; the machine has no say in it
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def count_batcher(threshold: int, timeout_ms: int | None, flush: bool, carry: tuple[str, ...] = ()) -> StatefulProcessor:
    """The processor of one shard.  Defined in a function, so that it travels to the executors by value."""
    columns = ["id", "text", *carry]

    class CountBatcher(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.rows = handle.getListState("rows", ", ".join(f"{c} string" for c in columns))
            self.place = handle.getValueState("place", "waiting long, batch_no long, seq long, due long")

        def _load(self) -> None:
            self.waiting, self.batch_no, self.seq, self.due = self.place.get() if self.place.exists() else (0, 0, 0, -1)

        def _store(self, now: int) -> None:
            """Batch and row numbers go on, they never repeat; a timer runs while rows wait."""
            if self.due >= 0 and not self.waiting:
                self.handle.deleteTimer(self.due)
                self.due = -1
            elif self.due < 0 and self.waiting and timeout_ms is not None:
                self.due = now + timeout_ms
                self.handle.registerTimer(self.due)
            self.place.update((self.waiting, self.batch_no, self.seq, self.due))

        def _release(self, shard: int, rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "shard", shard)
            out.insert(1, "batch_no", self.batch_no)
            out.insert(2, "seq", range(self.seq, self.seq + len(rows)))
            self.batch_no, self.seq = self.batch_no + 1, self.seq + len(rows)
            return out

        def _tail(self, shard: int) -> pd.DataFrame:
            rows = [tuple(r) for r in self.rows.get()]
            self.rows.clear()
            self.waiting = 0
            return self._release(shard, rows)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            self._load()
            shard, now = int(key[0]), timerValues.getCurrentProcessingTimeInMs()
            for pdf in rows:
                came = list(pdf[columns].itertuples(index=False, name=None))
                if self.waiting + len(came) >= threshold:
                    came = [tuple(r) for r in self.rows.get()] + came if self.waiting else came
                    self.rows.clear()
                    self.waiting = 0
                    full = len(came) - len(came) % threshold
                    for at in range(0, full, threshold):
                        yield self._release(shard, came[at:at + threshold])
                    came = came[full:]
                if came:
                    self.rows.appendList(came)
                    self.waiting += len(came)
            if flush and self.waiting:
                yield self._tail(shard)
            self._store(now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._load()
            self.due = -1               # this timer is gone
            if self.waiting:
                yield self._tail(int(key[0]))
            self._store(timerValues.getCurrentProcessingTimeInMs())

        def close(self) -> None:
            pass

    return CountBatcher()


def batch_by_count(stream: DataFrame, threshold: int = SCORING_BATCH, shards: int | None = None,
                   timeout_ms: int | None = None, key: str = "id", flush: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(shard, batch_no, seq, id, text, *carry) rows, released in batches of exactly ``threshold`` per
    shard; seq numbers a shard's rows as they came.  The stream is spread by a hash of the key over
    ``shards`` (1: a single buffer), whatever the session's parallelism: a restart must hit the shards in which rows
    wait.  Rows that wait ``timeout_ms`` are released, however few; ``flush`` releases the short tail at the end of
    every micro-batch.  ``carry`` names further string columns that travel along.

    A time-out keeps the stream running batches without rows, so it is for continuous triggers: a run over what is
    available would never end with one.  Spark refuses to go on with a checkpoint of the other kind.

    The state needs RocksDB: the session's state store provider is set to it, for queries started from now on.  A
    checkpoint written with other state (another provider, other ``carry``) cannot be continued."""
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    shard = F.pmod(F.hash(F.col(key)), F.lit(shards or SHARDS)).cast("int").alias("shard")
    schema = "shard int, batch_no long, seq long, id string, text string" + "".join(f", {c} string" for c in carry)
    rows = stream.select(shard, F.col(key).cast("string").alias("id"), "text", *carry)
    return rows.groupBy("shard").transformWithStateInPandas(
        count_batcher(threshold, timeout_ms, flush, tuple(carry)), schema, "Append",
        "None" if timeout_ms is None else "ProcessingTime")

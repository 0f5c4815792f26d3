"""Streaming: count-triggered batches (FIXTURES 3.7) and stream scoring = batch scoring."""

import os

from pyspark.sql import functions as F

from polarity.config import Settings
from polarity.operators.dictionary import build_dictionary
from polarity.operators.svm import predict, train_svm
from polarity.operators.vectors import score_space, vector_space
from polarity.sources.files import read_messages
from polarity.streaming.batches import batch_by_count, count_batcher
from polarity.streaming.stream import current_scores, intake, score_stream


def _messages(tmp, n, name="in"):
    d = os.path.join(tmp, name)
    os.makedirs(d)
    with open(os.path.join(d, "m.txt"), "w") as f:
        for i in range(n):
            f.write(f"id{i:04d}\tтекст номер {i} хороший день\n")
    return d


def test_count_triggered_batches(spark, tmp):
    src = _messages(tmp, 250)
    stream = read_messages(spark, "text", src)
    q = (batch_by_count(stream, threshold=100, shards=1).writeStream.format("memory")
         .queryName("batches").option("checkpointLocation", os.path.join(tmp, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT batch_no, count(*) AS n FROM batches GROUP BY batch_no ORDER BY batch_no").collect()
    assert [(r["batch_no"], r["n"]) for r in rows] == [(0, 100), (1, 100)]
    assert spark.sql("SELECT count(DISTINCT id) FROM batches").first()[0] == 200


def test_intake(spark, tmp):
    src = _messages(tmp, 3)
    q = (intake(read_messages(spark, "text", src)).writeStream.format("memory").queryName("intake")
         .option("checkpointLocation", os.path.join(tmp, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.sql("SELECT * FROM intake ORDER BY id").collect()
    assert r[0]["id"] == "id0000" and r[0]["clean_text"] == "текст номер хороший день" and r[0]["state"] == "ok"


def test_stream_equals_batch(spark, tmp):
    s = Settings(ngram_size=2, n_classes=2)
    corpus = spark.createDataFrame(
        [(i, t, e) for i, (t, e) in enumerate([("хороший день", 1), ("плохой день", -1), ("хороший хороший", 1),
                                                ("плохой плохой", -1), ("день хороший", 1), ("день плохой", -1)])],
        "doc_id long, text string, emotion int")
    d = build_dictionary(corpus, s)
    model = train_svm(vector_space(corpus, d, s), 10, s)
    src = _messages(tmp, 120)
    out = os.path.join(tmp, "scores")
    q = score_stream(read_messages(spark, "text", src), model, d, s, out, os.path.join(tmp, "ck3"), threshold=50)
    q.awaitTermination()
    streamed = {r["guid"]: r["label"] for r in current_scores(spark, out).collect()}
    assert len(streamed) == 120  # the end of the run flushes what is short of a batch
    texts = spark.read.text(src).select(F.split("value", "\t").getItem(0).alias("guid"),
                                         F.split("value", "\t").getItem(1).alias("text"))
    batch = {r["guid"]: r["label"] for r in predict(model, score_space(texts, d, s), "guid").collect()}
    assert all(batch[k] == v for k, v in streamed.items())


def test_replayed_batch_written_once(spark, tmp):
    from polarity.streaming.stream import score_batch
    s = Settings(ngram_size=2, n_classes=2)
    corpus = spark.createDataFrame([(0, "хороший день", 1), (1, "плохой день", -1)], "doc_id long, text string, emotion int")
    d = build_dictionary(corpus, s)
    model = train_svm(vector_space(corpus, d, s), 10, s)
    batch = spark.createDataFrame([("a", "плохой день", 0), ("a", "хороший день", 2), ("b", "плохой", 1), ("c", "", 3)], "id string, text string, seq long")
    out = os.path.join(tmp, "scores")
    score_batch(batch, 3, model, d, s, out)
    score_batch(batch, 3, model, d, s, out)  # replay after a failure
    labels = {r["guid"]: r["label"] for r in spark.read.parquet(out).collect()}
    assert labels == {"a": 1, "b": -1}  # of one key the last that came
    assert [(r["guid"], r["reason"]) for r in spark.read.parquet(out + "-errors").collect()] == [("c", "empty")]


def test_timeout_flushes_tail(spark, tmp):
    import time
    src = _messages(tmp, 250, "in_to")
    q = (batch_by_count(read_messages(spark, "text", src), threshold=100, shards=1, timeout_ms=500)
         .writeStream.format("memory").queryName("batches_to")
         .option("checkpointLocation", os.path.join(tmp, "ck_to")).trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            if spark.sql("SELECT count(*) FROM batches_to").first()[0] >= 250:
                break
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.sql("SELECT batch_no, count(*) AS n FROM batches_to GROUP BY batch_no ORDER BY batch_no").collect()
    assert [(r["batch_no"], r["n"]) for r in rows] == [(0, 100), (1, 100), (2, 50)]


def test_stream_equals_batch_job(spark, tmp):
    """P8 = P7: lemmas, errors, repeated keys, write-back, every one of 250 messages scored."""
    from polarity.plans import jobs
    from polarity.streaming.stream import written_back
    s = Settings(ngram_size=2, n_classes=2)
    lemmas = spark.createDataFrame([("хорошие", "хороший", "A"), ("плохие", "плохой", "A"), ("плохие", "плохо", "ADV"), ("дни", "день", "S")],
                                   "form string, lemma string, pos string")
    corpus = spark.createDataFrame([(0, "хороший день", 1), (1, "плохо день", -1)], "doc_id long, text string, emotion int")
    d = build_dictionary(corpus, s)
    model = train_svm(vector_space(corpus, d, s), 10, s)
    texts = ["хорошие дни", "плохие дни", "latin only", "дни", ""]
    src = os.path.join(tmp, "in")
    os.makedirs(src)
    with open(os.path.join(src, "m.txt"), "w") as f:
        for i in range(250):
            f.write(f"id{i:04d}\t{texts[i % 5]}\n")
        f.write("no tab\n")
    out = os.path.join(tmp, "scores")
    score_stream(read_messages(spark, "text", src), model, d, s, out, os.path.join(tmp, "ck"), threshold=100, lemma_dict=lemmas).awaitTermination()
    news = spark.createDataFrame([(i, f"id{i:04d}", texts[i % 5], None) for i in range(250)], "text_id long, guid string, text string, temote int")
    news = news.withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz"))
    batch = {r["guid"]: r["temote"] for r in jobs.score_batch(news, model, d, os.path.join(tmp, "state"), lemmas, s).collect()}
    assert {r["guid"]: r["temote"] for r in written_back(news, out).collect()} == batch
    assert sum(v is not None for v in batch.values()) == 150
    assert spark.read.parquet(out + "-errors").count() == 101


class _Shard:
    """State and timers of one shard in memory; how often the waiting rows were read is counted."""

    class _List:
        def __init__(self):
            self.kept, self.reads = [], 0

        def get(self):
            self.reads += 1
            return iter(self.kept)

        def appendList(self, rows):
            self.kept = self.kept + rows

        def clear(self):
            self.kept = []

    class _Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

    def __init__(self):
        self.rows, self.place, self.timers, self.now = self._List(), self._Value(), set(), 0

    def getListState(self, *_):
        return self.rows

    def getValueState(self, *_):
        return self.place

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def come(self, fn, n):
        import pandas as pd
        return [(b, s) for pdf in fn.handleInputRows((0,), [pd.DataFrame({"id": ["k"] * n, "text": ["t"] * n})], self) for b, s in zip(pdf["batch_no"], pdf["seq"])]

    def wait(self, fn, ms):
        self.now += ms
        out = []
        for due in [t for t in self.timers if t <= self.now]:
            self.timers.remove(due)
            out += [(b, s) for pdf in fn.handleExpiredTimer((0,), self, None) for b, s in zip(pdf["batch_no"], pdf["seq"])]
        return out


def test_batch_numbers_go_on_after_a_time_out():
    shard, fn = _Shard(), count_batcher(2, 10, False)
    fn.init(shard)
    assert shard.come(fn, 3) == [(0, 0), (0, 1)] and shard.wait(fn, 10) == [(1, 2)]
    assert shard.come(fn, 1) == [] and shard.timers == {20} and shard.wait(fn, 9) == []
    assert shard.come(fn, 1) == [(2, 3), (2, 4)] and not shard.timers       # a full batch leaves no timer
    assert shard.wait(fn, 100) == [] and shard.place.kept[0] == 0


def test_waiting_rows_are_read_only_when_a_batch_is_due():
    shard, fn = _Shard(), count_batcher(100, None, False)
    fn.init(shard)
    for _ in range(99):
        assert shard.come(fn, 1) == []
    assert shard.rows.reads == 0 and shard.come(fn, 1) == [(0, i) for i in range(100)] and shard.rows.reads == 1


def test_shard_without_new_rows_is_flushed_after_a_restart(spark, tmp):
    """Rows wait without a full batch; the stream ends; a continuous run gets rows of another shard only."""
    import time
    src, ck, out = (os.path.join(tmp, n) for n in ("in", "ck", "out"))
    os.makedirs(src)

    def put(name, ids):
        with open(os.path.join(src, name), "w") as f:
            f.writelines(f"{i}\tтекст\n" for i in ids)

    def until(done, seconds=90):
        rows = batch_by_count(read_messages(spark, "text", src), 10, 4, 15_000)
        q = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .trigger(processingTime="1 second").start())
        try:
            end = time.time() + seconds
            while not done(q) and time.time() < end:
                time.sleep(0.2)
        finally:
            q.stop()

    def written():
        return spark.read.parquet(out).count() if any(n.endswith(".parquet") for n in os.listdir(out)) else 0
    put("a.txt", ["a"] * 3)
    until(lambda q: any(p["numInputRows"] for p in q.recentProgress))
    assert written() == 0
    shard = F.pmod(F.hash("id"), F.lit(4)).alias("shard")
    of = {r["id"]: r["shard"] for r in spark.createDataFrame([(c,) for c in "abcdefghij"], "id string").select("id", shard).collect()}
    other = [c for c in of if of[c] != of["a"]]
    put("b.txt", other[:1] * 10)
    until(lambda q: written() == 13)
    rows = spark.read.schema("shard int, batch_no long, seq long, id string, text string").parquet(out)
    assert {r["id"]: r["count"] for r in rows.groupBy("id").count().collect()} == {"a": 3, other[0]: 10}


def test_messages_are_cleaned_before_they_wait(spark, tmp):
    """P8 = T1 -> T2: what is released is the cleaned text and its state."""
    src = os.path.join(tmp, "in")
    os.makedirs(src)
    with open(os.path.join(src, "m.txt"), "w") as f:
        f.write("a\tодин, two - три!\nb\tlatin\nc\t\n")
    cleaned = intake(read_messages(spark, "text", src)).select("id", F.col("clean_text").alias("text"), "state")
    (batch_by_count(cleaned, 100, 2, flush=True, carry=("state",)).writeStream.format("memory").queryName("cleaned")
     .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start().awaitTermination())
    assert {r["id"]: (r["text"], r["state"]) for r in spark.table("cleaned").collect()} == {
        "a": ("один три", "ok"), "b": ("", "foreign"), "c": ("", "empty")}

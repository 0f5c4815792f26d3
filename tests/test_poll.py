"""T4 as a stream: equal to the batch form, whole and without repeats over restarts and failures."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from polarity.sources.tables import scan_unscored
from polarity.streaming.poll import next_rows, poll_available, poll_stream

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "text_id long, guid string, date timestamp_ntz, temote int, text string"


def _rows(first, n, day, scored=()):
    return [(i, f"g{i}", None if day is None else DAY + datetime.timedelta(days=day), 1 if i in scored else None, "t") for i in range(first, first + n)]


def _news(spark, tmp):
    path = os.path.join(tmp, "news")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)
    return add, lambda session: session.read.schema(SCHEMA).parquet(path)


def _keeper(seen):
    def handle(rows, batch):
        seen.setdefault(batch, []).append(sorted(r["text_id"] for r in rows.collect()))
    return handle


def test_stream_equals_batch_form(spark, tmp):
    """Batch by batch; the second day has more rows than three batches, some are scored already."""
    add, read = _news(spark, tmp)
    add(_rows(0, 3, 0) + _rows(100, 17, 1, scored=(103, 104)) + _rows(50, 4, 2))
    seen, ck = {}, os.path.join(tmp, "ck")
    assert poll_available(spark, read, _keeper(seen), ck, limit=5) == 5
    since, expected = None, []
    while rows := scan_unscored(read(spark), since, limit=5).collect():
        since = max((r["date"], r["text_id"]) for r in rows)
        expected.append(sorted(r["text_id"] for r in rows))
    assert [s for _, s in sorted(seen.items())] == [[e] for e in expected]
    # nothing new; then a row of the last day behind the position, one before it, and a new day
    assert poll_available(spark, read, _keeper(seen), ck, limit=5) == 0
    add(_rows(60, 1, 2) + _rows(40, 1, 2) + _rows(1, 2, 5))
    seen.clear()
    assert poll_available(spark, read, _keeper(seen), ck) == 1 and list(seen.values()) == [[[1, 2, 60]]]


def test_failed_batch_runs_again_over_the_same_rows(spark, tmp):
    """The handler fails after the position is stored; rows that came meanwhile, inside the range or behind it, follow by position."""
    add, read = _news(spark, tmp)
    add(_rows(0, 4, 0))
    seen, ck = {}, os.path.join(tmp, "ck")
    keep = _keeper(seen)

    def fails(rows, batch):
        keep(rows, batch)
        raise RuntimeError("lost")
    with pytest.raises(Exception, match="lost"):
        poll_available(spark, read, fails, ck, limit=3)
    add(_rows(10, 2, 0))
    assert poll_available(spark, read, keep, ck, limit=3) == 2
    assert list(seen.values()) == [[[0, 1, 2], [0, 1, 2]], [[3, 10, 11]]]
    assert len([p for p in os.listdir(os.path.join(ck, "positions")) if p.startswith("p-")]) <= 2


def test_rows_without_a_date_come_first_and_once(spark, tmp):
    add, read = _news(spark, tmp)
    add(_rows(0, 3, None) + _rows(5, 2, 1))
    seen = {}
    assert poll_available(spark, read, _keeper(seen), os.path.join(tmp, "ck"), limit=2) == 3
    assert [s[0] for _, s in sorted(seen.items())] == [[0, 1], [2, 5], [6]]


def test_repeated_rows_of_a_position_stay_together_and_empty_table(spark, tmp):
    add, read = _news(spark, tmp)
    add([])
    seen, ck = {}, os.path.join(tmp, "ck")
    assert poll_available(spark, read, _keeper(seen), ck, limit=2) == 0 and not seen
    add(_rows(0, 1, 0) * 3 + _rows(1, 1, 0))
    assert poll_available(spark, read, _keeper(seen), ck, limit=2) == 2
    assert [s[0] for _, s in sorted(seen.items())] == [[0, 0, 0], [1]]


def test_continuous_run_sees_rows_as_they_come(spark, tmp):
    import time
    add, read = _news(spark, tmp)
    add(_rows(0, 2, 0))
    seen = {}
    q = poll_stream(spark, read, _keeper(seen), os.path.join(tmp, "ck"), trigger={"processingTime": "500 milliseconds"})
    try:
        for rows, batches in ((None, 1), (_rows(2, 3, 1), 2)):
            if rows:
                add(rows)
            end = time.time() + 60
            while len(seen) < batches and time.time() < end:
                time.sleep(0.2)
    finally:
        q.stop()
    assert [s[-1] for _, s in sorted(seen.items())] == [[0, 1], [2, 3, 4]]


def test_the_date_reaches_the_source(spark, tmp):
    add, read = _news(spark, tmp)
    add(_rows(0, 2, 0) + _rows(5, 2, 1))
    folder = os.path.join(tmp, "positions")
    next_rows(read(spark), folder, 0, 2)
    plan = next_rows(read(spark), folder, 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan


def test_scored_as_it_is_polled(spark, tmp):
    from polarity.config import Settings
    from polarity.operators.dictionary import build_dictionary
    from polarity.operators.svm import train_svm
    from polarity.operators.vectors import vector_space
    from polarity.sources import deltas
    from polarity.streaming.poll import score_polled
    s = Settings(ngram_size=2, n_classes=2)
    corpus = spark.createDataFrame([(0, "хороший день", 1), (1, "плохой день", -1)], "doc_id long, text string, emotion int")
    d = build_dictionary(corpus, s)
    model = train_svm(vector_space(corpus, d, s), 10, s)
    news = spark.createDataFrame([(i, f"g{i}", DAY, None, t) for i, t in enumerate(["хороший", "плохой", "latin", "хороший день"])], SCHEMA)
    out, ck = os.path.join(tmp, "scores"), os.path.join(tmp, "ck")

    def read(session):      # scores that are written back are no longer new, whatever the position says
        return deltas.apply_scores(news, out)
    assert poll_available(spark, read, score_polled(model, d, s, out), ck, limit=2) == 2
    assert {r["guid"]: r["temote"] for r in read(spark).collect()} == {"g0": 1, "g1": -1, "g2": None, "g3": 1}
    assert [(r["guid"], r["reason"]) for r in spark.read.parquet(out + "-errors").select("guid", "reason").collect()] == [("g2", "foreign")]

"""Tables replaced whole: a write stopped at any step leaves the old table, a later one succeeds."""

import pytest

from polarity.sources import atomic, sinks


def values(df):
    return sorted(r[0] for r in df.collect())


def test_replace_and_read(spark, tmp):
    path = tmp + "/t"
    assert atomic.read_table(spark, path) is None
    atomic.replace_table(spark.range(3), path)
    first = atomic.read_table(spark, path)
    atomic.replace_table(first.selectExpr("id + 10 AS id"), path)          # from the table itself
    assert values(atomic.read_table(spark, path)) == [10, 11, 12] and values(first) == [0, 1, 2]
    for n in range(4):
        atomic.replace_table(spark.range(n), path)
    assert atomic.versions(spark, path) == [5, 6] and values(atomic.read_table(spark, path)) == [0, 1, 2]
    spark.range(2).write.parquet(tmp + "/plain")
    assert values(atomic.read_table(spark, tmp + "/plain")) == [0, 1]


@pytest.mark.parametrize("step", ["write", "_publish", "_clean"])
def test_stopped_writes(spark, tmp, monkeypatch, step):
    path = tmp + "/t"
    atomic.replace_table(spark.range(2), path)

    def stop(*_):
        raise KeyboardInterrupt

    broken = spark.range(5)
    with monkeypatch.context() as m:
        if step == "write":
            broken = broken.selectExpr("id", "CASE WHEN id = 4 THEN raise_error('lost') END AS x")
        else:
            m.setattr(atomic, step, stop)
        with pytest.raises(BaseException):
            atomic.replace_table(broken, path)
    assert values(atomic.read_table(spark, path)) == (list(range(5)) if step == "_clean" else [0, 1])
    atomic.replace_table(spark.range(1), path)
    assert values(atomic.read_table(spark, path)) == [0]
    assert not [c for c in atomic._children(spark, path) if c.startswith("_new-")]


@pytest.mark.parametrize("step", ["_publish", "_clean"])
def test_watermark_survives_a_stop(spark, tmp, monkeypatch, step):
    rows = spark.createDataFrame([("2024-01-02", "b"), ("2024-01-01", "a")], "date string, guid string")
    path = tmp + "/mark"
    sinks.save_watermark(rows, path, key="guid")
    assert sinks.load_position(spark, path) == ("2024-01-02", "b")

    def stop(*_):
        raise KeyboardInterrupt

    later = spark.createDataFrame([("2024-02-01", "c")], "date string, guid string")
    with monkeypatch.context() as m:
        m.setattr(atomic, step, stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.save_watermark(later, path, key="guid")
    assert sinks.load_position(spark, path) == (("2024-01-02", "b") if step == "_publish" else ("2024-02-01", "c"))
    sinks.save_watermark(later, path, key="guid")
    assert sinks.load_watermark(spark, path) == "2024-02-01"


def test_dictionary_is_replaced_whole(spark, tmp, monkeypatch):
    path = tmp + "/dictionary"
    sinks.write_dictionary(spark.range(3), path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(atomic, "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_dictionary(spark.range(9), path)
    assert values(atomic.read_table(spark, path)) == [0, 1, 2]

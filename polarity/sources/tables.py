"""Table scans (S1-S4, S11, S13) and ordering / limit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, fmt: str = "parquet", path: str | None = None,
               **options) -> DataFrame:
    """Any Spark source: parquet/orc/json/csv by path, or jdbc with url/dbtable options.
    Filters and column selections downstream are pushed into the source by Catalyst."""
    r = spark.read.format(fmt).options(**options)
    return r.load(path) if path is not None else r.load()


def ordered(df: DataFrame, key: str) -> DataFrame:
    """O1: rows in key order (a range-partitioned global sort)."""
    return df.orderBy(key)


def limited(df: DataFrame, key, n: int) -> DataFrame:
    """At most n rows; ordered by the key (a column or several) first so repeated runs return
    the same rows (Spark plans this as TakeOrderedAndProject: a per-partition top-n, no full sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df if n is None or n < 0 else df.orderBy(*keys).limit(n)


def scan_labelled(news: DataFrame, label: str = "myemote", limit: int = -1,
                  key: str = "text_id") -> DataFrame:
    """Rows whose human label is set; optional row limit (-1 = all)."""
    return limited(news.where(F.col(label).isNotNull()), key, limit)


def scan_labelled_since(news: DataFrame, corpus: DataFrame, label: str = "myemote",
                        date: str = "date", limit: int = -1, key: str = "text_id") -> DataFrame:
    """Labelled rows newer than the newest date already stored in the corpus.
    The newest date is a scalar subquery; an empty corpus means every labelled row.  With a limit,
    rows come in (date, key) order and the next run goes on behind the last stored pair, so a day
    with more rows than the limit is finished before the next."""
    cond = F.col(label).isNotNull()
    if limit is None or limit < 0:
        newest = corpus.select(F.max(date)).scalar()
        return news.where(cond & (newest.isNull() | (F.col(date) > newest)))
    newest = corpus.select(F.max(F.struct(F.col(date), F.col(key)))).scalar()
    return limited(news.where(cond & (newest.isNull() | (F.struct(F.col(date), F.col(key)) > newest))), [date, key], limit)


def scan_unscored(news: DataFrame, since, score: str = "temote", date: str = "date",
                  limit: int = -1, key: str = "text_id") -> DataFrame:
    """S3: rows at or after the watermark (inclusive) that have no machine score yet.  With a limit,
    rows come in (date, key) order, so the newest date handed out is a safe watermark.  ``since``
    may be a (date, key) pair, the last row handled: rows behind it follow, and a day with more
    rows than the limit cannot stall."""
    cond = F.col(score).isNull()
    if isinstance(since, tuple):
        day, last = F.lit(since[0]).cast("timestamp_ntz"), F.lit(since[1])
        cond = cond & ((F.col(date) > day) | ((F.col(date) == day) & (F.col(key) > last)))
    elif since is not None:
        cond = cond & (F.col(date) >= F.lit(since).cast("timestamp_ntz"))
    return limited(news.where(cond), [date, key], limit)


def scan_queue(queue: DataFrame, texts: DataFrame, limit: int | None = None, key: str = "id",
               score: str = "score") -> DataFrame:
    """S4 + J1: no limit -> the whole queue; with a limit -> queue rows whose text has no
    score yet (inner equi-join on the key), n of them in key order."""
    if limit is None or limit < 0:
        return queue
    j = queue.join(texts.select(key, score), key).where(F.col(score).isNull()).drop(score)
    return limited(j, key, limit)


def pick_fields(df: DataFrame, with_title: bool = True, with_text: bool = True,
                title: str = "title", text: str = "text") -> DataFrame:
    """the content to analyse: title and/or text joined by a blank."""
    cols = ([F.col(title)] if with_title else []) + ([F.col(text)] if with_text else [])
    if not cols:
        raise ValueError("choose the title, the text or both")
    return df.withColumn("content", F.concat_ws(" ", *cols))


def table_size(df: DataFrame) -> DataFrame:
    """Number of rows of a table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def newest_date(df: DataFrame, date: str = "date", label: str | None = None) -> DataFrame:
    """The newest date, with ``label`` of the rows that have one."""
    return (df if label is None else df.where(F.col(label).isNotNull())).agg(F.max(date).alias("newest"))


def scan_category(news: DataFrame, category: str, with_title: bool = True,
                  with_text: bool = True, category_col: str = "category") -> DataFrame:
    """Texts of one category with the chosen fields."""
    return pick_fields(news.where(F.col(category_col) == category), with_title=with_title,
                       with_text=with_text)

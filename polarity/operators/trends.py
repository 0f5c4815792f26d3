"""Trend words of a category: frequency table, filters and word clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.config import CYRILLIC_WORD
from polarity.functions.text import words
from polarity.operators.cluster import assign_clusters, kmeans, som
from polarity.sources.tables import scan_category


def categories(news: DataFrame, col: str = "category") -> DataFrame:
    """The categories present and their text counts."""
    return news.groupBy(col).agg(F.count(F.lit(1)).alias("n_texts"))


def trend_words(news: DataFrame, category: str, with_title: bool = True, with_text: bool = True,
                pattern: str = CYRILLIC_WORD, key: str = "text_id") -> DataFrame:
    """(word, n, n_texts) of one category: occurrences and texts containing the word.
    Two plain aggregations (per text, then per word), no distinct-count expansion."""
    c = scan_category(news, category, with_title=with_title, with_text=with_text)
    w = c.repartition(key).select(key, F.explode(words("content", pattern)).alias("word"))
    per_text = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))
    return per_text.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_texts"))


def drop_stop_words(word_df: DataFrame, stop: DataFrame, word: str = "word",
                    stop_col: str = "value") -> DataFrame:
    """remove the stop words (left anti join)."""
    return word_df.join(stop.select(F.col(stop_col).alias(word)).distinct(), word, "left_anti")


def word_features(word_df: DataFrame) -> DataFrame:
    """Features of a trend word: [ln(1 + n), ln(1 + n_texts)]."""
    return word_df.withColumn("features", F.array(F.log(1 + F.col("n").cast("double")),
                                                  F.log(1 + F.col("n_texts").cast("double"))))


def drop_clusters(word_df: DataFrame, assign: DataFrame, ids, word: str = "word") -> DataFrame:
    """remove the words assigned to the given clusters."""
    drop = assign.where(F.col("cluster").isin(list(ids))).select(word)
    return word_df.join(drop, word, "left_anti")


def cluster_words(word_df: DataFrame, k: int, metric: str = "euclidean", max_iter: int = 100,
                  seed: int = 7, centroids=None) -> DataFrame:
    """Cluster the trend words on their frequency features: (word, cluster)."""
    f = word_features(word_df)
    if centroids is not None:
        return assign_clusters(f, centroids, metric).select("word", "cluster")
    out, _, _ = kmeans(f, k, metric, max_iter=max_iter, seed=seed, key="word")
    return out


def export_words(word_df: DataFrame, path: str) -> None:
    """The trend words as a csv folder with a header."""
    word_df.write.mode("overwrite").option("header", True).csv(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The exported trend words: (word, n, n_texts)."""
    return spark.read.schema("word string, n bigint, n_texts bigint").option("header", True).csv(path)


def map_words(word_df: DataFrame, rows: int, cols: int, iters: int = 10, seed: int = 7) -> DataFrame:
    """M11 of the trend words: a self-organising map of their frequency features: (word, unit)."""
    out, _ = som(word_features(word_df), rows, cols, iters, seed, key="word")
    return out

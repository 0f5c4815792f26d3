"""Trend-word queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polarity.config import LETTER_WORD
from polarity.functions.text import words
from polarity.operators.lemma import drop_pos
from polarity.operators.trends import cluster_words, drop_clusters, drop_stop_words, trend_words
from polarity.plans import testbed as tb
from polarity.plans.jobs import trend_report
from polarity.queries.registry import register, with_ctes, words_sql
from polarity.session import scratch_path

TW = ("tw", f"SELECT word, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_texts FROM (SELECT text_id, word, count(*) AS c FROM "
            f"(SELECT text_id, unnest({words_sql('content')}) AS word FROM (SELECT text_id, concat_ws(' ', title, text) AS content "
            f"FROM ({tb.NEWS_SQL}) WHERE category = '{tb.CATEGORY}')) GROUP BY text_id, word) GROUP BY word")
STOP_SQL = f"SELECT DISTINCT unnest({words_sql('text')}) AS value FROM benchmark"
CENTROIDS = [[0.0, 0.0], [2.0, 2.0], [4.0, 4.0]]


def _tw(spark, sf):
    return trend_words(tb.news(spark, sf), tb.CATEGORY, pattern=LETTER_WORD)


@register("trend_words", with_ctes(TW, select="SELECT word, n, n_texts FROM tw"))
def q_trend_words(spark, sf):
    return _tw(spark, sf)


@register("drop_stop_words", with_ctes(TW, ("stop", STOP_SQL), select=(
    "SELECT word, n FROM tw WHERE word NOT IN (SELECT value FROM stop)")))
def q_drop_stop_words(spark, sf):
    """the stop list is the words of the benchmark passages."""
    stop = tb.table(spark, sf, "benchmark").select(F.explode(words("text", LETTER_WORD)).alias("value"))
    return drop_stop_words(_tw(spark, sf), stop).select("word", "n")


@register("drop_pos", with_ctes(TW, ("ld", tb.lemma_dict_sql()), select=(
    "SELECT word, n FROM tw WHERE word NOT IN (SELECT form FROM ld WHERE pos IN ('FUNC', 'ADV'))")))
def q_drop_pos(spark, sf):
    """remove function words and adverbs."""
    return drop_pos(_tw(spark, sf), tb.lemma_dict(spark, sf), ["FUNC", "ADV"]).select("word", "n")


def _assign_sql() -> str:
    cents = " UNION ALL ".join(f"SELECT {i} AS cluster, {c[0]} AS c0, {c[1]} AS c1" for i, c in enumerate(CENTROIDS))
    return (f"SELECT w.word, arg_min(c.cluster, ((ln(1 + w.n) - c.c0) * (ln(1 + w.n) - c.c0) + "
            f"(ln(1 + w.n_texts) - c.c1) * (ln(1 + w.n_texts) - c.c1), c.cluster)) AS cluster "
            f"FROM tw w, ({cents}) c GROUP BY w.word")


@register("word_clusters_fixed", with_ctes(TW, ("a", _assign_sql()), select="SELECT word, CAST(cluster AS INTEGER) AS cluster FROM a"))
def q_word_clusters_fixed(spark, sf):
    """M10 one assignment: trend words to three fixed frequency centroids."""
    return cluster_words(_tw(spark, sf), 3, centroids=CENTROIDS)


@register("drop_clusters", with_ctes(TW, ("a", _assign_sql()), select=(
    "SELECT word, n FROM tw WHERE word NOT IN (SELECT word FROM a WHERE cluster = 2)")))
def q_drop_clusters(spark, sf):
    """remove the high-frequency cluster (2) found by the fixed-centroid assignment."""
    tw = _tw(spark, sf)
    assign = cluster_words(tw, 3, centroids=CENTROIDS)
    return drop_clusters(tw, assign, [2]).select("word", "n")


@register("trend_report", with_ctes(TW, ("stop", STOP_SQL), ("a", _assign_sql()), ("ld", tb.lemma_dict_sql()), select=(
    "SELECT word, n, n_texts FROM tw WHERE word NOT IN (SELECT word FROM a WHERE cluster = 2) AND word NOT IN "
    "(SELECT form FROM ld WHERE pos IN ('FUNC', 'ADV')) AND word NOT IN (SELECT value FROM stop)")))
def q_trend_report(spark, sf):
    """P9 whole: words of a category, the frequent cluster, function words and adverbs and the stop words removed, exported,
    mapped; what is returned is the export, read back."""
    stop = tb.table(spark, sf, "benchmark").select(F.explode(words("text", LETTER_WORD)).alias("value"))
    return trend_report(tb.news(spark, sf), tb.CATEGORY, scratch_path(spark, "trend"), stop, drop_ids=[2], settings=tb.WORDS,
                        pos_dict=tb.lemma_dict(spark, sf), drop_classes=["FUNC", "ADV"], centroids=CENTROIDS,
                        map_path=scratch_path(spark, "trend-map"))


@register("word_clusters")
def q_word_clusters(spark, sf):
    """K-means (k = 4) over the trend-word features."""
    return cluster_words(_tw(spark, sf), 4, "euclidean", seed=7)

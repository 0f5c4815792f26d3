"""Lemmatisation by a (form, lemma, pos) dictionary and lexical-class filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.config import CYRILLIC_WORD
from polarity.functions.text import words


def lemmatise(df: DataFrame, lemma_dict: DataFrame, key: str = "doc_id", text_col: str = "text",
              pattern: str = CYRILLIC_WORD, out: str = "lemma_text", unique: bool = False) -> DataFrame:
    """Replace each word by its lemma; unknown forms stay as they are.

    The texts are dealt by key once; both the words and the join back read that exchange.  Words
    are exploded with their position and joined to the dictionary, one lemma per form (of several
    entries the smallest (lemma, pos); ``unique`` tells that there are none), then regrouped per text
    in position order.  The dictionary is broadcast only below Spark's measured threshold; then the
    regrouping begins in the task that holds the text, and one row per text is exchanged.  The lemmas
    go back to the texts by a sort-merge join: neither side may be broadcast.  ``key`` is unique.
    Texts without words get ''.
    """
    entry = F.struct("lemma", *(["pos"] if "pos" in lemma_dict.columns else []))
    one = lemma_dict.where(F.col("lemma").isNotNull())
    one = one.select("form", F.col("lemma").alias("_lemma")) if unique else one.groupBy("form").agg(F.min(entry)["lemma"].alias("_lemma"))
    df = df.repartition(key)
    w = df.select(key, F.posexplode(words(text_col, pattern)).alias("_at", "form")).join(one, "form", "left")
    g = w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_lemma", "form").alias("_l")))).alias("_w"))
    lem = g.select(key, F.array_join(F.col("_w._l"), " ").alias(out))
    return df.join(lem.hint("merge"), key, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def drop_pos(word_df: DataFrame, pos_dict: DataFrame, classes, word: str = "word") -> DataFrame:
    """remove words whose lexical class is one of ``classes``."""
    drop = pos_dict.where(F.col("pos").isin(list(classes))).select(F.col("form").alias(word))
    return word_df.join(drop, word, "left_anti")

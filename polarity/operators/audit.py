"""Text inspection utilities: key lookups, source filter, key lists, audit counts (F3-F5, J2, J5,
A12, K13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.config import CYRILLIC_WORD
from polarity.functions.text import clean, text_state


def lookup(df: DataFrame, guid=None, date=None, guid_col: str = "guid",
           date_col: str = "date") -> DataFrame:
    """rows with one key value: a guid, or a date (all rows of that day)."""
    if (guid is None) == (date is None):
        raise ValueError("give exactly one of guid or date")
    if guid is not None:
        return df.where(F.col(guid_col) == F.lit(guid))
    return df.where(F.to_date(date_col) == F.lit(date).cast("date"))


def by_source(news: DataFrame, sources: DataFrame, types=("news", "np-news"), category=None,
              source_col: str = "source_id", category_col: str = "category") -> DataFrame:
    """F5 + J2: texts whose source has one of the types (and of a category).

    The sources table is filtered first; Catalyst broadcasts it when its measured size is
    under the broadcast threshold, else shuffles both sides."""
    s = sources.where(F.col("type").isin(list(types))).select(F.col("id").alias(source_col))
    out = news.join(s, source_col, "left_semi")
    if category is not None:
        out = out.where(F.col(category_col) == F.lit(category))
    return out


def lookup_list(df: DataFrame, keys: DataFrame, col: str = "guid", key_col: str = "value") -> DataFrame:
    """Rows whose key is in a key list (left semi join; an empty list gives no rows)."""
    k = keys.select(F.col(key_col).alias(col)).distinct()
    return df.join(k, col, "left_semi")


def text_audit(df: DataFrame, text_col: str = "text", pattern: str = CYRILLIC_WORD, by: str | None = None) -> DataFrame:
    """Texts seen, foreign (no word of the script), empty; per value of ``by`` if given."""
    groups = [by] if by else []
    return df.select(*groups, text_state(text_col, pattern).alias("_s")).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("_s") == "foreign").alias("foreign_texts"),
        F.count_if(F.col("_s") == "empty").alias("empty_texts"))


def export_clean(df: DataFrame, key: str = "guid", text_col: str = "text",
                 pattern: str = CYRILLIC_WORD) -> DataFrame:
    """(guid, clean_text) in one table instead of two parallel files."""
    return df.select(key, clean(text_col, pattern).alias("clean_text"))

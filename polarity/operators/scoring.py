"""Score write-back and batch bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.config import CYRILLIC_WORD
from polarity.functions.text import text_state


def last_label(scores: DataFrame, key: str = "guid", seq: str = "seq",
               label: str = "label") -> DataFrame:
    """One label per key, the one with the largest sequence value (last write wins; of equal
    sequence values the largest label).
    max_by is a plain aggregate: partial per task, so a hot key never gathers its rows."""
    return scores.groupBy(key).agg(F.max_by(label, F.struct(seq, label)).alias(label))


def upsert_scores(texts: DataFrame, scores: DataFrame, key: str = "guid",
                  score_col: str = "temote", label: str = "label", seq: str | None = "seq") -> DataFrame:
    """K8 + J6: texts with new scores applied by key (new score wins, others keep theirs).

    Scores are reduced to one per key first (last wins when ``seq`` is given, else they must
    be unique), so applying the same scores twice gives the same table (idempotent)."""
    one = last_label(scores, key, seq, label) if seq else scores.select(key, label)
    j = texts.join(one.withColumnRenamed(label, "_new"), key, "left")
    return j.select(*[F.coalesce(F.col("_new"), F.col(score_col)).cast(texts.schema[score_col].dataType)
                      .alias(score_col) if c == score_col else F.col(c) for c in texts.columns])


def last_rows(df: DataFrame, key: str, order) -> DataFrame:
    """One row per key, the last in ``order`` (columns): a key that comes twice is scored once.
    A plain aggregate, partial per task, so a hot key never gathers its rows."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in df.columns])


def route_errors(df: DataFrame, key: str = "guid", text_col: str = "text",
                 pattern: str = CYRILLIC_WORD) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad rows carry the key and the reason (empty / foreign)."""
    s = df.withColumn("_state", text_state(text_col, pattern))
    good = s.where(F.col("_state") == "ok").drop("_state")
    bad = s.where(F.col("_state") != "ok").select(key, F.col("_state").alias("reason"))
    return good, bad


def batch_report(texts: DataFrame, errors: DataFrame, scores: DataFrame) -> DataFrame:
    """Texts handled, texts routed to the errors, scores sent."""
    def count(df):
        return df.select(F.count(F.lit(1))).scalar()
    return texts.agg(F.count(F.lit(1)).alias("texts")).select("texts", count(errors).alias("errors"), count(scores).alias("scores"))


def apply_once(scores: DataFrame, key: str = "guid") -> DataFrame:
    """T5: a replayed batch adds nothing new: one row per key (of different rows the largest)."""
    return last_rows(scores, key, [c for c in scores.columns if c != key])

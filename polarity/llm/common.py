"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.session import write_table

#: A word: a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to the workers with the task, so that executors need not have
    this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words in a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df`` (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with helper columns _file and _row that name each row's place in its files; a
    frame that is no plain file scan (under projections and filters) is written to the shared folder first: after
    an explode or a join one file row may stand in several rows."""
    file, row = fresh_names(docs, "_file", "_row")

    def add(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.withColumns({file: at["file_path"], row: at["row_index"]})

    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if not plan.nodeName().startswith("LogicalRelation") and plan.nodeName() not in ("Relation", "DataSourceV2Relation"):
        return add(write_table(docs, "located"))
    try:
        out = add(docs)
        out.schema  # noqa: B018  resolves the metadata column
        return out
    except PySparkException:
        return add(write_table(docs, "located"))

"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of the budget, at most ``max_repeat`` times its size; what
lies above is shared out again by weight among the others until none is above.  Every document
of a source expects target / size copies.  In each source the documents stand in order of size
(then id), their expected copies are summed up, one random offset is added, and a document is
taken once for each whole number that its part of the sum crosses.  As the order is by size, the
words taken lie within about one document of the target, and reruns agree.

The prefix sum is a rank within the source times the source's expected copies: a source that holds
a third of all rows is dealt over all tasks by range.  Targets come from one row a source, by
sums alone; sums and comparisons are in whole numbers, so they do not depend on the order of rows.

Defined results: null text and text without words have size 0 (taken 0 words); a null source is a
source of its own, last in order; rows that repeat an id or a text are rows of their own; an empty
table has an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import fresh_names, located, word_count
from polarity.llm.ranking import rank_within
from polarity.operators.ids import dense_ids
from polarity.session import write_table

WEIGHTS = (3, 1, 2)
BUDGET = (3, 2)          # 150 % of all words
MAX_REPEAT = 2
SEED = 13


def random_offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def source_targets(sized: DataFrame, weights=WEIGHTS, budget=BUDGET, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    order = dense_ids(sources, ["_null", "source"], "_place", start=0)
    listed = F.array(*map(F.lit, weights))
    sources = write_table(order.select("source", "source_size",
                                       F.get(listed, (F.col("_place") % len(weights)).cast("int")).cast("bigint").alias("weight")), "mix-sources")
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    total, all_weight = sources.agg(F.sum(size), F.sum(weight)).first()
    up, down = budget
    above, capped = F.lit(False), (0, 0)
    while total is not None:
        # words a unit of weight gets, as a fraction; above the bound are those with size * bound < it * weight
        words = int(up * total - down * max_repeat * capped[0])
        units = int(down * (all_weight - capped[1]))
        if not units:
            break
        above = size * F.lit(max_repeat * units) < weight * F.lit(words).cast("decimal(38,0)")
        now = tuple(int(x or 0) for x in sources.filter(above).agg(F.sum(size), F.sum(weight)).first())
        if now == capped:
            break
        capped = now
    if total is None:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.lit(float(words)) * F.col("weight") / F.lit(float(units or 1))
    return sources.select("source", "source_size",
                          F.when(above | F.lit(not units), (max_repeat * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = SEED, **plan) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken, file, row."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    sized = write_table(placed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                      word_count(text_col).alias("size"),
                                      F.col(file).alias("file"), F.col(row).alias("row")), "mix-sized")
    targets = write_table(source_targets(sized, **plan), "mix-targets")
    ranked = rank_within(sized, "source", ["size", "id", "file", "row"], "before")
    out = ranked.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.lit(random_offset(seed))
    copies = F.floor(offset + (F.col("before") + 1) * each) - F.floor(offset + F.col("before") * each)
    return (out.withColumn("copies", copies)
            .select("id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"), "file", "row"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seed: int = SEED, **plan) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, all columns as they were."""
    placed = located(docs)
    file, row = placed.columns[-2:]
    n = mix(placed, id_col, text_col, source_col, seed, **plan).filter("copies > 0")
    (times,) = fresh_names(placed, "_times")
    out = placed.join(n.select(F.col("file").alias(file), F.col("row").alias(row), F.col("copies").alias(times)), [file, row])
    return (out.select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times))
            .drop(times))

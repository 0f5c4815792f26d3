"""n-gram terms of texts and the n-gram dictionary (per-class counts, document counts, idf)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from polarity.config import Settings
from polarity.functions.text import ngrams, words
from polarity.operators.ids import dense_ids
from polarity.operators.packed import range_bounds, sum_ranges
from polarity.session import packed_partitions, partitions_for

# n-gram counting travels with its tasks: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOUND_PARTS = 4                 # partitions' worth of texts whose n-grams tell the dictionary's ranges
TASK_WORDS = 1 << 17            # words whose n-grams a task counts at once; a longer text stands alone


def positive(label_col) -> Column:
    """Neutral 0 counts as positive."""
    return F.col(label_col) >= 0


def exploded_ngrams(texts: DataFrame, key: str, text_col: str, settings: Settings,
                    carry=()) -> DataFrame:
    """One row per n-gram occurrence: (key, *carry, ngram)."""
    # words first as their own column: a lambda that referenced the regex directly would
    # re-run it for every position of the text
    w = texts.select(key, *carry, words(text_col, settings.pattern).alias("_w"))
    return w.select(key, *carry, F.explode(ngrams("_w", settings.ngram_size)).alias("ngram"))


def _counted(rows: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """Of rows (..., words), a row (..., ngram, c) per distinct n-gram of each row."""
    lists = rows.column(rows.num_columns - 1)
    flat, size = lists.flatten().cast(pa.large_string()), lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(rows.num_rows), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))               # words from here to the row's end
    grams, owner = [], []
    for j in range(1, n + 1):
        at = np.flatnonzero(left >= j)
        one = [flat.take(pa.array(at + k)) for k in range(j)]
        grams.append(pc.binary_join_element_wise(*one, pa.scalar(" ", pa.large_string())) if j > 1 else one[0])
        owner.append(row[at])
    named = pa.concat_arrays(grams).dictionary_encode()
    kinds = max(1, len(named.dictionary))
    found, c = np.unique(np.concatenate(owner) * kinds + named.indices.to_numpy(), return_counts=True)
    take = pa.array(found // kinds)
    return pa.RecordBatch.from_arrays(
        [*(x.take(take) for x in rows.columns[:-1]), named.dictionary.take(pa.array(found % kinds)).cast(pa.string()), pa.array(c.astype(np.int64))],
        names=[*rows.schema.names[:-1], "ngram", "c"])


def row_terms(texts: DataFrame, key: str, text_col: str, settings: Settings, carry=()) -> DataFrame:
    """(key, *carry, ngram, c) of each row on its own: a few rows' n-grams at a time are counted in the task, so no
    table of them is held and nothing spills.  Rows that share a key are not added up."""
    n = settings.ngram_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(b.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // TASK_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if size[start:end].any():
                    yield _counted(b.slice(start, end - start), n)

    w = texts.select(key, *carry, words(text_col, settings.pattern).alias("_w"))
    schema = StructType([*w.schema.fields[:-1], StructField("ngram", StringType()), StructField("c", LongType())])
    return w.mapInArrow(run, schema)


def terms(texts: DataFrame, key: str = "doc_id", text_col: str = "text",
          settings: Settings = Settings(), carry=()) -> DataFrame:
    """(key, *carry, ngram, c): how often each n-gram occurs in each text.

    The texts (small next to their n-grams) are hash-partitioned by ``key``, in partitions of a bounded
    share of the input; a text's n-grams are counted within its row.  Only rows that share their key are added up by an
    aggregation, which needs no exchange of its own.  The one terms-sized shuffle left in a
    dictionary or vector plan is the one on the n-gram.  ``carry`` columns must be
    functionally dependent on ``key``.
    """
    same = Window.partitionBy(key, *carry)
    base = texts.select(key, *carry, text_col).repartition(partitions_for(texts), key).withColumn("_n", F.count(F.lit(1)).over(same))
    once = row_terms(base.filter("_n = 1"), key, text_col, settings, carry)
    more = exploded_ngrams(base.filter("_n > 1"), key, text_col, settings, carry)
    return once.unionByName(more.groupBy(key, *carry, "ngram").agg(F.count(F.lit(1)).alias("c")))


def by_ngram(term_df: DataFrame) -> DataFrame:
    """The terms dealt out by n-gram: one row per text and n-gram at most, so no n-gram outgrows a partition."""
    return term_df.repartition(partitions_for(term_df), "ngram")


def ngram_counts(term_df: DataFrame, label: str = "emotion") -> DataFrame:
    """A1: occurrences of each n-gram in positive and negative texts."""
    pos = positive(label)
    return by_ngram(term_df.select("ngram", label, "c")).groupBy("ngram").agg(
        F.sum(F.when(pos, F.col("c")).otherwise(F.lit(0))).alias("in_texts_p"),
        F.sum(F.when(~pos, F.col("c")).otherwise(F.lit(0))).alias("in_texts_n"))


def ngram_docfreq(term_df: DataFrame, label: str = "emotion") -> DataFrame:
    """A2: number of positive / negative texts containing each n-gram (one term row per text)."""
    pos = positive(label)
    return by_ngram(term_df.select("ngram", label)).groupBy("ngram").agg(F.count_if(pos).alias("texts_with_p"),
                                        F.count_if(~pos).alias("texts_with_n"))


def idf(n_texts, texts_with) -> Column:
    """V2: ln(N / df), 6 decimals as the reference stores it."""
    n = n_texts if isinstance(n_texts, Column) else F.lit(n_texts)
    return F.round(F.log(n.cast("double") / texts_with), 6)


def dictionary_stats(term_df: DataFrame, n_texts: Column, label: str = "emotion", bounds: list[str] | None = None) -> DataFrame:
    """A1 + A2 + V2 in one aggregation over the terms (one shuffle on ngram; by the ranges of n-grams that ``bounds`` cut, if given)."""
    pos = positive(label)
    if bounds is not None:
        one = F.lit(1).cast("bigint")
        parts = {"in_texts_n": (~pos, F.col("c")), "in_texts_p": (pos, F.col("c")), "texts_with_n": (~pos, one), "texts_with_p": (pos, one)}
        agg = sum_ranges(term_df.select("ngram", *[F.when(which, x).otherwise(F.lit(0)).alias(name) for name, (which, x) in parts.items()]), "ngram", bounds)
        return agg.withColumn("idf", idf(n_texts, F.col("texts_with_p") + F.col("texts_with_n")))
    agg = by_ngram(term_df.select("ngram", label, "c")).groupBy("ngram").agg(
        F.sum(F.when(~pos, F.col("c")).otherwise(F.lit(0))).alias("in_texts_n"),
        F.sum(F.when(pos, F.col("c")).otherwise(F.lit(0))).alias("in_texts_p"),
        F.count_if(~pos).alias("texts_with_n"),
        F.count_if(pos).alias("texts_with_p"))
    return agg.withColumn("idf", idf(n_texts, F.col("texts_with_p") + F.col("texts_with_n")))


def build_dictionary(corpus: DataFrame, settings: Settings = Settings(), key: str = "doc_id",
                     text_col: str = "text", label: str = "emotion") -> DataFrame:
    """n_gramm_id, n_gramm, in_texts_n, in_texts_p, texts_with_n, texts_with_p, idf.

    N is the real number of corpus texts (a scalar subquery, no driver round trip).  Ids are
    dense 1..V in binary string order of the n-gram.  The terms are dealt out by ranges of n-grams, so
    that one shuffle serves the counts and the ids; where to cut them is told by the n-grams of some of the texts.
    """
    n_texts = corpus.select(F.count(F.lit(1))).scalar()
    t = terms(corpus, key, text_col, settings, carry=(label,))
    n = packed_partitions(t)
    some = corpus.where(F.pmod(F.xxhash64(key, text_col), F.lit(max(1, n // BOUND_PARTS))) == 0)
    drawn = (row_terms(x.select(key, text_col), key, text_col, settings).select(key, "ngram") for x in (some, corpus))
    bounds = next((b for b in (range_bounds(x, "ngram", n) for x in drawn) if b), [])          # all texts if none of the drawn has an n-gram
    stats = dictionary_stats(t, n_texts, label, bounds).withColumnRenamed("ngram", "n_gramm")
    return dense_ids(stats, "n_gramm", "n_gramm_id", ranged=True).select(
        "n_gramm_id", "n_gramm", "in_texts_n", "in_texts_p", "texts_with_n", "texts_with_p", "idf")


def refresh_idf(dictionary: DataFrame, n_texts) -> DataFrame:
    """Recompute idf of a stored dictionary for a new corpus size."""
    return dictionary.withColumn(
        "idf", idf(n_texts, F.col("texts_with_p") + F.col("texts_with_n")))

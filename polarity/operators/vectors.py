"""Sparse tf-idf vectors of texts against a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.config import Settings
from polarity.functions.text import strict_number
from polarity.operators.dictionary import terms
from polarity.operators.packed import collect_parts, join_parts
from polarity.session import packed_partitions


def target(label_col, n_classes: int) -> Column:
    """two classes -> 1 when label >= 0 else -1; five classes -> label unchanged; null stays null."""
    c = F.col(label_col) if isinstance(label_col, str) else label_col
    if n_classes == 2:
        return F.when(c >= 0, F.lit(1)).when(c < 0, F.lit(-1)).cast("int")
    return c.cast("int")


def lookup_terms(term_df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """J3 + F12: keep the n-grams found in the dictionary and attach (id, idf).

    One equi-join on the n-gram for all texts.  Terms are pre-aggregated per text, so a very
    frequent n-gram has at most one row per text.
    """
    d = dictionary.select(F.col("n_gramm").alias("ngram"), F.col("n_gramm_id").alias("id"), "idf")
    return join_dealt(term_df, d, "ngram")


def join_dealt(many: DataFrame, one: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Equi-join of a table that grows with the data with one that has a row per ``on`` and grows as well.

    Both sides are dealt out by ``on`` in partitions of a bounded share of the input, packed.  A hash table of
    each partition of ``one`` is asked for: it is as bounded as the partition, and neither side is
    sorted by Spark.  The planner on its own sizes exploded terms by the text file and might broadcast them.
    """
    return join_parts(many, one, on, how, packed_partitions(many, one))


def _weights(arr: Column, m: Column, d: Column, settings: Settings) -> Column:
    """Weights for a per-text array of struct(id, c, idf); m and d must be plain column refs
    (an expression here would be re-evaluated for every element inside the lambda)."""

    def w(x):
        base = x["idf"] * x["c"] / m if settings.use_tf else x["idf"]
        if settings.norm == "scale":
            return base * d
        return F.when(d > 0, base / d).otherwise(F.lit(0.0))
    return F.transform(arr, w)


def collect_vectors(matched: DataFrame, key: str, settings: Settings, keys: DataFrame | None = None) -> DataFrame:
    """O2 + A4 + A5 + V3 + V4: one row per text with idx (ascending) and weight arrays.

    A text's terms are bounded by its own length, so collecting them per key is bounded.
    m (distinct matched n-grams) and d = sqrt(sum idf^2) come out of the same aggregation.
    ``keys`` (one row per text, extra columns allowed) are unioned into the same aggregation so
    texts without any known n-gram keep a row, without a join back to the texts.
    """
    cols = [c for c in (keys.columns if keys is not None else [key])]
    m = matched.select(*cols, "id", "c", "idf")
    if keys is not None:
        m = m.unionByName(keys.select(*cols, F.lit(None).cast("bigint").alias("id"),
                                      F.lit(None).cast("bigint").alias("c"),
                                      F.lit(None).cast("double").alias("idf")))
    g = collect_parts(m, cols, packed_partitions(m), "idf")
    vals = _weights(F.col("_t"), F.col("n_terms"), F.col("norm"), settings)
    return g.select(*cols, "n_terms", "norm", F.col("_t.id").alias("idx"), vals.alias("val"))


def vector_space(corpus: DataFrame, dictionary: DataFrame, settings: Settings = Settings(),
                 key: str = "doc_id", text_col: str = "text", label: str = "emotion") -> DataFrame:
    """M1: (key, target, n_terms, norm, idx, val) for every corpus text; empty texts get no terms."""
    base = corpus.select(key, text_col, target(label, settings.n_classes).alias("target"))
    t = terms(base, key, text_col, settings, carry=("target",))
    return collect_vectors(lookup_terms(t, dictionary), key, settings, keys=base.select(key, "target"))


def score_space(texts: DataFrame, dictionary: DataFrame, settings: Settings = Settings(),
                key: str = "guid", text_col: str = "text") -> DataFrame:
    """M2: (key, n_terms, norm, idx, val) for texts to score; texts with no known n-gram keep
    a row with 0 terms (they are scored 0)."""
    t = terms(texts, key, text_col, settings)
    return collect_vectors(lookup_terms(t, dictionary), key, settings, keys=texts.select(key))


def explode_vectors(vectors: DataFrame, key: str, extra=()) -> DataFrame:
    """(key, *extra, idx, val) one row per stored element."""
    z = F.explode(F.arrays_zip("idx", "val")).alias("_e")
    return vectors.select(key, *extra, z).select(key, *extra, F.col("_e.idx").alias("idx"),
                                                 F.col("_e.val").alias("val"))


# ---------------------------------------------------------------- text formats

def _fmt(v: Column) -> Column:
    """Weights are written as their shortest round-trip decimal text."""
    return v.cast("string")


def labelled_lines(vectors: DataFrame, label: str = "target", sep: str = "\t") -> DataFrame:
    """K4: ``label<sep>idx:val<sep>idx:val`` per text (libsvm layout)."""
    pairs = F.transform(F.arrays_zip("idx", "val"),
                        lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), _fmt(e["val"])))
    body = F.when(F.size("idx") > 0, F.array_join(pairs, sep))   # no trailing separator
    return vectors.select(F.concat_ws(sep, F.col(label).cast("string"), body).alias("value"))


def keyed_lines(vectors: DataFrame, key: str = "guid") -> DataFrame:
    """K5: ``guid:n_terms<TAB>idx:val...``; texts without terms give ``guid:0``."""
    pairs = F.transform(F.arrays_zip("idx", "val"),
                        lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), _fmt(e["val"])))
    head = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("n_terms").cast("string"))
    body = F.when(F.size("idx") > 0, F.array_join(pairs, "\t"))
    return vectors.select(F.concat_ws("\t", head, body).alias("value"))


def parse_vector_lines(lines: DataFrame, keyed: bool = False) -> DataFrame:
    """S7 / S8 + F8: parse ``head idx:val ...`` lines (tab or blank separated) and validate.

    Output: line_no, head (label text or key), n_terms (keyed ``key:count`` heads), idx, val,
    error (null when the line is valid).  A line is valid when the label is an integer (labelled
    form), every index is an integer, indexes strictly increase and every value is a number.
    """
    toks = F.filter(F.split(F.col("value"), r"[ \t]+"), lambda x: x != "")
    df = lines.select("line_no", toks.alias("_tok"))
    head = F.get("_tok", F.lit(0))        # get: a malformed line is reported, it does not stop the job
    items = F.slice(F.col("_tok"), 2, F.greatest(F.size("_tok") - 1, F.lit(0)))
    pairs = F.transform(items, lambda x: F.struct(
        strict_number(F.get(F.split(x, ":", 2), F.lit(0)), "bigint").alias("i"),
        strict_number(F.get(F.split(x, ":", 2), F.lit(1)), "double").alias("v")))
    df = df.select("line_no", head.alias("head"), pairs.alias("_p"))
    # idx / val as their own columns: lambdas below must not re-extract them per element
    df = df.select("line_no", "head", "_p", F.col("_p.i").alias("idx"), F.col("_p.v").alias("val"))
    bad_idx = F.exists("_p", lambda p: p["i"].isNull())
    bad_val = F.exists("_p", lambda p: p["v"].isNull())
    nxt = F.slice("idx", 2, F.greatest(F.size("idx") - 1, F.lit(0)))
    not_inc = F.exists(F.zip_with(nxt, "idx", lambda b, a: b <= a), lambda x: x)
    not_inc = F.when(F.size("idx") >= 2, not_inc).otherwise(F.lit(False))
    if keyed:
        key = F.get(F.split("head", ":", 2), F.lit(0))
        cnt = F.get(F.split("head", ":", 2), F.lit(1))
        head_ok = F.lit(True)
        # a bare key: as many terms as follow it
        out_head = [key.alias("key"), F.when(cnt.isNull(), F.size("idx")).otherwise(strict_number(cnt, "int")).alias("n_terms")]
    else:
        head_ok = strict_number(F.col("head"), "int").isNotNull()
        out_head = [strict_number(F.col("head"), "int").alias("label")]
    err = (F.when(F.col("head").isNull(), F.lit("empty line"))
           .when(~head_ok, F.lit("label is not a number"))
           .when(bad_idx, F.lit("index is not an integer"))
           .when(bad_val, F.lit("value is not a number"))
           .when(not_inc, F.lit("indexes do not increase")))
    return df.select("line_no", *out_head, "idx", "val", err.alias("error"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Rows, stored elements and the largest index of a vector set."""
    return vectors.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.coalesce(F.sum(F.size("idx")), F.lit(0)).cast("bigint").alias("n_elements"),
                       F.max(F.array_max("idx")).alias("max_index"))

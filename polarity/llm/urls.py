"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled table of URLs: those that the rules decide, at most
``PER_LABEL`` distinct (host, path) of each verdict, chosen by hash (so a host that holds a third
of all pages does not fill it); the bound is on the labelled rows only.  Every page is judged.

Only DataFrame operations run here (Spark ML's transformers are such).  Defined results: a null URL or one
without :// has an empty host and path, fits no rule and is judged by the model like any other; rows
that repeat are judged each; with no labelled URL the verdict is allow, with one label only it is
that label; very long URLs are read whole; other columns take no part.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.llm.common import lower_ascii, text_or_empty
from polarity.session import write_table

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PER_LABEL = 2000         # labelled URLs of each verdict that the classifier is fitted on
N_GRAM = 3
FEATURES = 1 << 14


def host_and_path(url: str) -> tuple[Column, Column]:
    u = text_or_empty(url)
    rest = F.when(F.contains(u, F.lit("://")), F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, struct<rule, verdict>; null if none does."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit("." + h).alias("under"), F.lit(p).alias("path"),
                                F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in by_length])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, r["under"])) & F.startswith(path, r["path"]))
    return F.get(fits, 0)


def grams(c: Column, n: int = N_GRAM) -> Column:
    """Character n-grams of a text between end marks; of one shorter than n, that alone."""
    whole = F.concat(F.lit("^"), c, F.lit("$"))
    chars = F.split(whole, "")
    out = chars
    for k in range(1, n):      # shifted copies side by side: linear in the text's length
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.length(whole)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.slice(out, F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1)))


def features(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path) with the hashed n-grams of both, each marked with where it is from."""
    both = F.concat(F.transform(grams(F.col("host")), lambda g: F.concat(F.lit("h"), g)),
                    F.transform(grams(F.col("path")), lambda g: F.concat(F.lit("p"), g)))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(
        pages.withColumn("grams", both))


def labelled_urls(judged: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The bounded training table (host, path, label 1 = block) of rows (host, path, verdict)."""
    known = judged.filter("verdict IS NOT NULL").select("host", "path", "verdict").distinct()
    def some(verdict):
        return (known.filter(F.col("verdict") == verdict).orderBy(F.xxhash64("host", "path"), "host", "path").limit(per_label))
    return write_table(some("allow").union(some("block")).coalesce(1)
                       .select("host", "path", (F.col("verdict") == "block").cast("double").alias("label")), "url-labels")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    return LogisticRegression(maxIter=100, regParam=0.01, tol=1e-6).fit(features(labelled))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, per_label: int = PER_LABEL) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, by_model."""
    host, path = host_and_path(url_col)
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = (parts.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
             .select("id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")))
    labelled = labelled_urls(ruled, per_label)
    labels = [r.label for r in labelled.select("label").distinct().collect()]      # two at most
    if len(labels) == 2:
        scored = train(labelled).transform(features(ruled))
        guess = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    else:
        scored, guess = ruled, F.lit("block" if labels == [1.0] else "allow")
    return scored.select("id", "host", "path", "rule", F.coalesce("verdict", guess).alias("verdict"),
                         F.col("verdict").isNull().alias("by_model"))

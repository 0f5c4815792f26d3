"""Packed shuffles give the rows of the plain ones."""

import math

import pytest
from pyspark.sql import functions as F

from polarity.operators import packed
from polarity.plans import testbed as tb

SF = "/root/testdata/sf0.001"
ODD = [(None, 1, None, 2.5), ("", 2 ** 40, "x", -0.0), ("a b", -5, None, 0.0), ("é", None, "y", float("nan")), ("a b", 7, "", None),
       ("a b", 7, "", None), ("zz", -2 ** 63, "x", 1e300), (None, None, None, None)]
SCHEMA = "ngram string, k long, t string, x double"


def told(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_columns_come_out_as_they_went_in():
    import pyarrow as pa
    columns = [pa.array(x) for x in zip(*[(n, k, t, x, i % 2 == 0) for i, (n, k, t, x) in enumerate(ODD)])]
    for part in (slice(0, len(ODD)), slice(1, 3), slice(0, 1), slice(0, 0)):
        some = [c[part] for c in columns]
        back = packed.unpack(packed.pack(some), [c.type for c in some])
        assert [repr(c.to_pylist()) for c in back] == [repr(c.to_pylist()) for c in some]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_is_the_plain_join(spark, monkeypatch, how):
    """Null and repeated keys of both sides included, however few rows are packed at once."""
    many = spark.createDataFrame(ODD * 3, SCHEMA)
    one = spark.createDataFrame([("a b", 1, 0.5), ("a b", 2, None), ("é", None, 1.5), (None, 3, 1.0), ("unknown", 4, 1.0)], "ngram string, id long, idf double")
    want = told(many.join(one, "ngram", how))
    for rows, n in ((packed.CHUNK_ROWS, 5), (2, 1), (2, 40)):
        monkeypatch.setattr(packed, "CHUNK_ROWS", rows)
        got = packed.join_parts(many, one, "ngram", how, n)
        assert got.columns == many.join(one, "ngram", how).columns and told(got) == want
    assert told(packed.join_parts(many, one.limit(0), "ngram", how, 3)) == told(many.join(one.limit(0), "ngram", how))
    assert told(packed.join_parts(many.limit(0), one, "ngram", how, 3)) == []


def test_sums_lie_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_ROWS", 100)
    rows = spark.range(1000).select(F.concat(F.lit("é"), (F.col("id") % 97).cast("string")).alias("ngram"), F.col("id").alias("a"), F.lit(1).cast("bigint").alias("b"))
    want = told(rows.groupBy("ngram").agg(F.sum("a"), F.sum("b")))
    bounds = packed.range_bounds(rows.select("ngram", "a"), "ngram", 6)
    assert 3 <= len(bounds) <= 5
    for some in (bounds, []):
        got = packed.sum_ranges(rows, "ngram", some)
        assert told(got) == want
        parts = [p for p in got.rdd.map(lambda r: r[0]).glom().collect() if p]
        assert len(parts) == len(some) + 1 and [x for p in parts for x in p] == sorted(x for p in parts for x in p)
    assert packed.range_bounds(rows.limit(0).select("ngram", "a"), "ngram", 6) == []


def test_collected_are_the_groups(spark):
    rows = [("a", 1, 5, 1, 0.5), ("a", 1, 3, 2, 2.0), ("a", 2, 9, 1, 1.0), ("b", None, None, None, None), (None, 1, 4, 1, 3.0), (None, 1, None, None, None), ("a", 1, 3, 2, None)]
    df = spark.createDataFrame(rows, "guid string, target int, id long, c long, idf double")
    got = {(r["guid"], r["target"]): ([tuple(t) for t in r["_t"]], r["n_terms"], round(r["norm"], 9)) for r in packed.collect_parts(df, ["guid", "target"], 3, "idf").collect()}
    assert {k: (sorted(map(repr, t)), n, x) for k, (t, n, x) in got.items()} == {
        k: (sorted(map(repr, t)), n, round(x, 9)) for k, (t, n, x) in {("a", 1): ([(3, 2, 2.0), (3, 2, None), (5, 1, 0.5)], 3, math.sqrt(4.25)), ("a", 2): ([(9, 1, 1.0)], 1, 1.0),
                                                                    ("b", None): ([], 0, 0.0), (None, 1): ([(4, 1, 3.0)], 1, 3.0)}.items()}
    assert [t[0] for t in got["a", 1][0]] == [3, 3, 5]
    assert packed.collect_parts(df.limit(0), ["guid"], 3).count() == 0


def test_names_send_each_partition_its_own(spark):
    for n in (1, 7, 40):
        names = spark.createDataFrame([(int(x),) for x in packed._names(n)], "x int")
        assert [r[0] for r in names.select(F.pmod(F.hash("x"), F.lit(n))).collect()] == list(range(n))


@pytest.mark.parametrize("name", ["vectors", "tfidf", "idf_only", "tf", "text_norm", "vector_stats", "serving_vectors", "dictionary_lookup", "oov_rate"])
def test_no_shuffle_of_plain_terms(spark, name):
    """Terms, dictionary and matches are shuffled packed."""
    from polarity.queries import load_all
    plan = load_all()[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert not any("(ngram#" in line for line in exchanges) and sum("(ngram_part#" in line for line in exchanges) == 2


def test_dictionary_ranges_without_a_sample(spark, monkeypatch):
    """Few texts, none of which is drawn to tell the ranges: the same dictionary."""
    from polarity.operators import dictionary as dic
    c = tb.corpus(spark, SF).limit(20)
    want = told(dic.build_dictionary(c, tb.WORDS))
    monkeypatch.setattr(dic, "packed_partitions", lambda *frames: 100_000)
    monkeypatch.setattr(dic, "sum_ranges", lambda rows, by, bounds: packed.sum_ranges(rows, by, bounds[:7]))
    assert told(dic.build_dictionary(c, tb.WORDS)) == want


from hypothesis import given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from polarity.config import LETTER_WORD, Settings
from polarity.functions.text import ngrams, prefix_number, split_list
from polarity.operators.dictionary import build_dictionary
from polarity.operators.ids import dense_ids

WORDS = st.lists(st.sampled_from(["а", "б", "в", "гд"]), min_size=0, max_size=12)


@hsettings(max_examples=15, deadline=None)
@given(w=WORDS, n=st.integers(1, 4))
def test_ngram_count_formula(spark, w, n):
    df = spark.createDataFrame([(w,)], "w array<string>")
    got = df.select(ngrams("w", n).alias("g")).first()["g"]
    L = len(w)
    assert len(got) == sum(max(0, L - j + 1) for j in range(1, n + 1))
    expect = [" ".join(w[i:i + j]) for j in range(1, n + 1) for i in range(0, L - j + 1)]
    assert got == expect


def test_dictionary_independent_of_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    c = docs.withColumn("emotion", (F.col("doc_id") % 3 - 1).cast("int"))
    s = Settings(pattern=LETTER_WORD)
    a = build_dictionary(c.repartition(1), s).orderBy("n_gramm_id").collect()
    b = build_dictionary(c.repartition(7), s).orderBy("n_gramm_id").collect()
    assert a == b
    assert all(r["texts_with_p"] <= r["in_texts_p"] and r["texts_with_n"] <= r["in_texts_n"] for r in a)


def test_dense_ids_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    r = dense_ids(df, "k", "rid", start=5, partitions=6).orderBy("k").collect()
    assert [x["rid"] for x in r] == list(range(5, 1005))
    assert [x["k"] for x in r] == list(range(1000))


def test_prefix_number_and_split(spark):
    df = spark.createDataFrame([("12abc",), (" 2.5",), ("abc",), (" ",), ("-3e2x",)], "s string")
    assert [r[0] for r in df.select(prefix_number("s")).collect()] == [12.0, 2.5, 0.0, 0.0, -300.0]
    df = spark.createDataFrame([("a,,b,",)], "s string")
    assert df.select(split_list("s", ",")).first()[0] == ["a", "b"]

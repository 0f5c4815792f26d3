"""End-to-end batch jobs (P1-P7, P9-P11) on the small test tables; exercises the sinks."""

import os

import pytest
from pyspark.sql import functions as F

from polarity.config import LETTER_WORD, Settings
from polarity.plans import jobs
from polarity.plans import testbed as tb
from polarity.sources import sinks
from polarity.sources.atomic import read_table
from polarity.streaming.stream import poll_new

SF = "/root/testdata/sf0.001"
S = Settings(pattern=LETTER_WORD, n_classes=2)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("jobs"))
    news = tb.news(spark, SF)
    lemmas = tb.lemma_dict(spark, SF)
    early = news.where(F.col("date") < F.lit("2024-01-15").cast("timestamp_ntz"))
    corpus_path = os.path.join(base, "corpus")
    jobs.build_corpus(early, corpus_path, lemmas, S)
    jobs.update_corpus(news, corpus_path, lemmas, S)
    corpus = spark.read.parquet(corpus_path)
    d = jobs.build_dictionary(corpus, os.path.join(base, "dictionary"), S)
    model, vectors = jobs.train(corpus, d, S, os.path.join(base, "vectors"))
    return base, news, lemmas, corpus, d, model, vectors


def test_corpus_ids_continue(spark, built):
    _, news, _, corpus, _, _, _ = built
    labelled = news.where(F.col("myemote").isNotNull()).count()
    ids = sorted(r[0] for r in corpus.select("corpus_id").collect())
    assert ids == list(range(1, labelled + 1))
    early_max = corpus.where(F.col("date") < F.lit("2024-01-15").cast("timestamp_ntz")).agg(F.max("corpus_id")).first()[0]
    late_min = corpus.where(F.col("date") >= F.lit("2024-01-15").cast("timestamp_ntz")).agg(F.min("corpus_id")).first()[0]
    assert late_min == early_max + 1
    row = corpus.where(F.col("lemma_text") != "").first()
    assert row["lemma_text"] == row["lemma_text"].lower()


def test_dictionary_written(spark, built):
    base, _, _, _, d, _, _ = built
    assert read_table(spark, os.path.join(base, "dictionary")).count() == d.count() > 0


def test_evaluate_run_writes_metrics(spark, built):
    base, _, _, _, _, model, vectors = built
    out = os.path.join(base, "eval")
    m = {r["name"]: r["value"] for r in jobs.evaluate_run(model, vectors, out, 2).collect()}
    assert 0 <= m["accuracy"] <= 1 and m["accuracy"] > 0.5
    lines = spark.read.text(os.path.join(out, "results")).collect()
    assert any(r[0].startswith("accuracy;") for r in lines)
    assert any(p.startswith("result-") for p in os.listdir(out))


def test_score_batch_and_watermark(spark, built):
    base, news, lemmas, _, d, model, _ = built
    state = os.path.join(base, "state")
    out = jobs.score_batch(news, model, d, state, lemmas, S)
    scored = out.where(F.col("temote").isNotNull()).count()
    ok_rows = out.where(F.size(F.regexp_extract_all("text", F.lit(f"({LETTER_WORD})"), 1)) > 0).count()
    assert scored == ok_rows
    wm = sinks.load_watermark(spark, os.path.join(state, "watermark"))
    assert wm == news.agg(F.max("date")).first()[0]
    # T4: polling the scored table again returns only rows at the watermark
    again = poll_new(out, os.path.join(state, "watermark"))
    assert again.where(F.col("date") < F.lit(wm)).count() == 0


def test_trend_report_audit_export(spark, built):
    base, news, lemmas, _, _, _, _ = built
    stop = spark.createDataFrame([("le",), ("la",)], "value string")
    w = jobs.trend_report(news, "fr", os.path.join(base, "trend"), stop=stop, k=3, drop_ids=[2],
                          settings=Settings(pattern=LETTER_WORD))
    assert w.where(F.col("word").isin("le", "la")).count() == 0
    assert spark.read.option("header", True).csv(os.path.join(base, "trend")).count() == w.count()
    a = jobs.audit(news, Settings(pattern=tb.ACCENTED)).first()
    assert a["texts"] == news.count()
    e = jobs.export_category(news, tb.sources(spark, SF), tb.SOURCE_TYPES, "fr", os.path.join(base, "exp"),
                             settings=Settings(pattern=LETTER_WORD))
    assert e.count() == spark.read.parquet(os.path.join(base, "exp")).count()


def test_import_corpus(spark, tmp):
    p = os.path.join(tmp, "legacy.txt")
    with open(p, "w") as f:
        f.write("text\nхороший день\nemot\n1\ndate\n2014-05-01\ntext\nплохой\nдень\nemot\n-1\ndate\n2014-05-02\n")
    c = jobs.import_corpus(spark, p, os.path.join(tmp, "corpus"), settings=Settings())
    r = c.orderBy("corpus_id").collect()
    assert [(x["corpus_id"], x["pretreat_text"], x["emotion"]) for x in r] == [(1, "хороший день", 1), (2, "плохой день", -1)]


import pytest
from pyspark.sql import functions as F

from polarity.config import Settings
from polarity.operators.audit import lookup_list
from polarity.operators.cluster import assign_clusters, update_centroids
from polarity.operators.dictionary import build_dictionary, terms
from polarity.operators.svm import train_svm
from polarity.operators.vectors import score_space, vector_space
from polarity.sources.tables import scan_labelled

S3 = Settings(ngram_size=3)


def test_one_word_and_empty_texts(spark):
    c = spark.createDataFrame([(1, "мир", 1), (2, "", -1), (3, "it's 'quoted' \"text\"", 0)],
                              "doc_id long, text string, emotion int")
    t = {(r["doc_id"], r["ngram"]): r["c"] for r in terms(c, settings=S3).collect()}
    assert t == {(1, "мир"): 1}
    d = build_dictionary(c, S3)
    assert [r["n_gramm"] for r in d.collect()] == ["мир"]
    v = {r["doc_id"]: r for r in vector_space(c, d, S3).collect()}
    assert v[2]["n_terms"] == 0 and v[3]["n_terms"] == 0 and v[1]["n_terms"] == 1


def test_unknown_ngrams_only(spark):
    c = spark.createDataFrame([(1, "мир труд", 1)], "doc_id long, text string, emotion int")
    d = build_dictionary(c, S3)
    t = spark.createDataFrame([("x", "другие слова"), ("x2", "мир")], "guid string, text string")
    r = {x["guid"]: x["n_terms"] for x in score_space(t, d, S3).collect()}
    assert r == {"x": 0, "x2": 1}


def test_null_label_not_scanned(spark):
    n = spark.createDataFrame([(1, 1), (2, None), (3, -2)], "text_id long, myemote int")
    assert sorted(r[0] for r in scan_labelled(n).select("text_id").collect()) == [1, 3]
    assert [r[0] for r in scan_labelled(n, limit=1).select("text_id").collect()] == [1]


def test_empty_key_list(spark):
    df = spark.createDataFrame([("a",), ("b",)], "guid string")
    keys = spark.createDataFrame([], "value string")
    assert lookup_list(df, keys).count() == 0
    dup = spark.createDataFrame([("a",), ("a",)], "value string")
    assert lookup_list(df, dup).count() == 1


def test_centroid_rule_in_one_dimension(spark):
    """In 1-D the per-dimension mean equals the reference's pooled mean."""
    pts = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 2, 10, 12])],
                                "id long, features array<double>")
    a = assign_clusters(pts, [[0.0], [11.0]], "manhattan")
    c = {r["cluster"]: r["features"][0] for r in update_centroids(a).collect()}
    assert c == {0: 1.0, 1: 11.0}


def test_limited_batches_score_every_text_once(spark, tmp):
    """A limit below the backlog, a day larger than the limit, texts that go to the errors."""
    from polarity.plans import jobs
    s = Settings(ngram_size=1, n_classes=2, texts_limit=3)
    corpus = spark.createDataFrame([(0, "хороший", 1), (1, "плохой", -1)], "doc_id long, text string, emotion int")
    d = build_dictionary(corpus, s)
    model = train_svm(vector_space(corpus, d, s), 2, s)
    rows = [(10 - i, f"g{i}", "latin" if i % 4 == 0 else "хороший", f"2024-01-0{1 + i // 6}") for i in range(11)]
    news = (spark.createDataFrame(rows, "text_id long, guid string, text string, day string")
            .select("text_id", "guid", "text", F.lit(None).cast("int").alias("temote"), F.col("day").cast("timestamp_ntz").alias("date")))
    for _ in range(6):
        out = jobs.score_batch(news, model, d, tmp, settings=s)
    assert {r["guid"]: r["temote"] for r in out.collect()} == {r[1]: 1 if r[2] == "хороший" else None for r in rows}
    scores = spark.read.parquet(tmp + "/scores")
    assert scores.count() == scores.select("guid").distinct().count() == 8
    assert spark.read.parquet(tmp + "/errors").count() == 3


def test_empty_batch_keeps_the_watermark(spark, tmp):
    from polarity.sources import sinks
    df = spark.createDataFrame([("2024-01-03", 5), ("2024-01-03", 7), ("2024-01-01", 9)], "d string, k long").select(F.col("d").cast("timestamp_ntz").alias("date"), "k")
    sinks.save_watermark(df, tmp + "/w", key="k")
    sinks.save_watermark(df.limit(0), tmp + "/w", key="k")
    day, key = sinks.load_position(spark, tmp + "/w")
    assert (str(day)[:10], key) == ("2024-01-03", 7)
    assert sinks.load_position(spark, tmp + "/none") is None


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_tagged_records_line_ends(spark, tmp, end):
    from polarity.sources.files import read_tagged_records
    import os
    lines = []
    for i in range(300):
        lines += ["text", f"line {i}", "textbook", "emot", str(i % 5 - 2), "date", f"2014-05-{1 + i % 28:02d}"]
    os.makedirs(tmp + "/r")
    with open(tmp + "/r/a.txt", "w", newline="") as f:
        f.write(end.join(lines) + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")      # records run across the splits
    try:
        got = sorted((r["text"], r["emotion"]) for r in read_tagged_records(spark, tmp + "/r").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"line {i}\ntextbook", i % 5 - 2) for i in range(300))


def test_malformed_vector_lines_are_reported(spark):
    from polarity.operators.vectors import parse_vector_lines
    lines = [(1, "1\tx"), (2, "  \t "), (3, "g1"), (4, "1 2:0.5"), (5, "1 :"), (6, "1 3:1 2:1")]
    df = spark.createDataFrame(lines, "line_no long, value string")
    got = {r["line_no"]: r["error"] for r in parse_vector_lines(df).collect()}
    assert got == {1: "index is not an integer", 2: "empty line", 3: "label is not a number", 4: None, 5: "index is not an integer", 6: "indexes do not increase"}
    keyed = {r["line_no"]: (r["key"], r["n_terms"]) for r in parse_vector_lines(df, keyed=True).collect()}
    assert keyed[3] == ("g1", 0)


def test_message_without_a_tab(spark):
    from polarity.functions.text import parse_message
    df = spark.createDataFrame([("a\tb\tc",), ("alone",), ("",)], "v string")
    assert [tuple(r["m"]) for r in df.select(parse_message("v").alias("m")).collect()] == [("a", "b\tc"), ("alone", ""), ("", "")]


def test_homonyms_have_one_lemma(spark):
    from polarity.operators.lemma import lemmatise
    d = spark.createDataFrame([("стали", "сталь", "S"), ("стали", "стать", "V"), ("дома", "дом", "S")], "form string, lemma string, pos string")
    df = spark.createDataFrame([(1, "стали дома стали"), (2, None), (3, "нет таких")], "doc_id long, text string")
    assert {r["doc_id"]: r["lemma_text"] for r in lemmatise(df, d).collect()} == {1: "сталь дом сталь", 2: "", 3: "нет таких"}


def test_null_and_foreign_labels(spark):
    from polarity.operators.vectors import target
    df = spark.createDataFrame([(None,), (0,), (-2,)], "e int")
    assert [r[0] for r in df.select(target("e", 2)).collect()] == [None, 1, -1]
    v = spark.createDataFrame([(1, 5, [1], [1.0]), (2, 1, [1], [1.0])], "doc_id long, target int, idx array<long>, val array<double>")
    with pytest.raises(Exception, match="label is none of"):
        train_svm(v, 1, Settings())


def test_undecided_prediction_is_no_hit(spark):
    from polarity.operators.evaluate import confusion2
    df = spark.createDataFrame([(0, 1), (0, -1), (1, 1), (-1, -1)], "pred int, target int")
    assert tuple(confusion2(df).first()) == (1, 1, 1, 1)


def test_ragged_points_have_distance_zero(spark):
    from polarity.functions import vecmath
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    assert tuple(df.select(vecmath.manhattan("a", "b"), vecmath.euclidean("a", "b"), vecmath.squared_euclidean("a", "b")).first()) == (0.0, 0.0, 0.0)


def test_draws_do_not_depend_on_partitioning(spark):
    from polarity.operators.cluster import seed_centroids
    p = spark.range(200).select("id", F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("features"))
    assert seed_centroids(p.repartition(1), 3) == seed_centroids(p.repartition(7), 3)


def test_saved_model_stands_alone(spark, tmp):
    """It predicts the same after its scratch folder is gone."""
    from polarity.operators.svm import predict
    from polarity.session import remove_path
    from polarity.sources.sinks import load_model, save_model
    s = Settings(ngram_size=1, n_classes=2)
    corpus = spark.createDataFrame([(0, "хороший", 1), (1, "плохой", -1)], "doc_id long, text string, emotion int")
    d = build_dictionary(corpus, s)
    v = vector_space(corpus, d, s)
    model = train_svm(v, 2, s)
    want = sorted(map(tuple, predict(model, v, "doc_id").collect()))
    save_model(spark, model, tmp + "/m")
    remove_path(spark, model.path)
    assert sorted(map(tuple, predict(load_model(spark, tmp + "/m"), v, "doc_id").collect())) == want


def test_learners_on_empty_tables(spark):
    """No points: no assignments, no centroids."""
    from polarity.operators.cluster import kmeans, kmeans_ml, som
    none = spark.createDataFrame([], "id long, features array<double>")
    for update in ("mean", "median"):
        out, cents, rounds = kmeans(none, 3, "manhattan", update=update)
        assert out.columns == ["id", "cluster"] and out.count() == 0 and cents == [] and rounds == 0
    assert kmeans_ml(none, 3).count() == 0
    out, code = som(none, 2, 2)
    assert out.count() == 0 and code == []


def test_median_update(spark):
    from polarity.operators.cluster import kmeans, update_medians
    rows = [(0, [1.0, 5.0]), (0, [2.0, 1.0]), (0, [9.0, 3.0]), (1, [4.0, 4.0]), (1, [8.0, 4.0])]
    got = {r["cluster"]: (r["n"], r["features"]) for r in update_medians(spark.createDataFrame(rows, "cluster int, features array<double>")).collect()}
    assert got == {0: (3, [2.0, 3.0]), 1: (2, [6.0, 4.0])}
    points = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 2, 100, 101, 200])], "id long, features array<double>")
    out, cents, _ = kmeans(points, 2, "manhattan", init=[[0.0], [100.0]], update="median")
    assert cents == [[1.0], [101.0]] and {r["id"]: r["cluster"] for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_split_list_without_items(spark, tmp):
    """a text that is empty or holds separators alone has no first item; that does not stop the job."""
    from polarity.queries import load_all
    q, _ = load_all()
    rows = [(1, "a.b"), (2, ""), (3, "..."), (4, None), (5, ".c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp}/documents.parquet")
    got = {r["doc_id"]: (r["n_items"], r["first_item"]) for r in q["split_list"](spark, tmp).collect()}
    assert got == {1: (2, "a"), 2: (0, ""), 3: (0, ""), 4: (None, ""), 5: (1, "c")}

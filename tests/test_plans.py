"""Plan shapes that matter at scale (checked on the physical plan text)."""

from pyspark.sql import functions as F

from polarity.config import LETTER_WORD, Settings
from polarity.operators.cluster import assign_clusters
from polarity.operators.dictionary import dictionary_stats, terms
from polarity.operators.vectors import lookup_terms
from polarity.plans import testbed as tb

SF = "/root/testdata/sf0.001"
S = Settings(pattern=LETTER_WORD)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dictionary_has_one_terms_shuffle(spark):
    c = tb.corpus(spark, SF)
    p = plan(dictionary_stats(terms(c, "doc_id", "text", S, carry=("emotion",)), F.lit(10)))
    exchanges = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len([e for e in exchanges if "ngram" in e]) == 1
    assert not any("ngram" in e and "doc_id" in e for e in exchanges)  # no per-text exchange
    assert "partial_sum" in p  # map-side partial aggregation before the shuffle


def test_lookup_is_one_equi_join(spark):
    c = tb.corpus(spark, SF)
    d = spark.createDataFrame([("the", 1, 0.5)], "n_gramm string, n_gramm_id long, idf double")
    p = plan(lookup_terms(terms(c, "doc_id", "text", S), d))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert sum(("HashJoin" in line or "SortMergeJoin" in line) and "ngram" in line for line in p.splitlines()) == 1


def test_lookup_sorts_neither_side(spark, tmp_path, monkeypatch):
    """Terms meet the dictionary by hash tables of bounded partitions, also where unknown n-grams stay (oov_rate)."""
    from polarity import session
    from polarity.queries import load_all
    q, _ = load_all()
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40)), "en", "s", 120) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("dictionary_lookup", "oov_rate"):
        p = plan(q[name](spark, str(tmp_path)))
        assert not any("SortMergeJoin [ngram" in line or "BroadcastHashJoin [ngram" in line for line in p.splitlines())
        assert sum("ShuffledHashJoin [ngram" in line for line in p.splitlines()) == 1
        assert all("REPARTITION_BY_NUM" in line for line in p.splitlines() if "Exchange hashpartitioning(ngram" in line)


def test_assignment_has_no_cross_join(spark):
    pts = tb.table(spark, SF, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    p = plan(assign_clusters(pts, [[0.0] * 64, [1.0] * 64], "manhattan"))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_scan_prunes_and_pushes(spark):
    from polarity.queries import load_all
    q, _ = load_all()
    p = plan(q["load_table"](spark, SF))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1000)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in p


def test_predict_has_no_cross_join(spark):
    from polarity.operators.dictionary import build_dictionary
    from polarity.operators.svm import predict, train_svm
    from polarity.operators.vectors import vector_space
    s = Settings(ngram_size=2, n_classes=5, multiclass="ovo")
    c = spark.createDataFrame([(0, "хороший день", 1), (1, "плохой день", -1), (2, "очень хороший", 2),
                               (3, "очень плохой", -2)], "doc_id long, text string, emotion int")
    d = build_dictionary(c, s)
    v = vector_space(c, d, s)
    p = plan(predict(train_svm(v, d.count(), s), v.withColumnRenamed("doc_id", "guid"), "guid"))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_terms_are_counted_within_rows(spark):
    """No aggregation over the n-grams of texts whose key is theirs alone; equal keys are added up."""
    p = plan(terms(tb.corpus(spark, SF), "doc_id", "text", S))
    assert sum("HashAggregate(keys=[doc_id" in line and "ngram" in line for line in p.splitlines()) <= 2     # equal keys only
    assert "(_n#" in p and "Window" in p
    rows = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, "b b"), (None, "a"), (None, "a b"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["ngram"], r["c"]) for r in terms(rows, "doc_id", "text", Settings(pattern=LETTER_WORD, ngram_size=2)).collect()}
    assert got == {(1, "a", 3), (1, "b", 1), (1, "a b", 1), (1, "b a", 1), (2, "b", 2), (2, "b b", 1), (None, "a", 2), (None, "b", 1), (None, "a b", 1)}


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    from polarity import session
    spark.range(1000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "PARTITION_BYTES", max(1, session.path_bytes(spark, str(tmp_path / "t")) // 40))
    assert session.partitions_for(t) >= 30
    assert terms(t, "doc_id", "text", S).groupBy(F.spark_partition_id()).count().count() >= 30


def test_row_terms_slices_agree(spark, monkeypatch):
    """A row's n-grams are the same however few words a task counts at once; words of a pattern with blanks add up."""
    from polarity.operators import dictionary as dic
    rows = spark.createDataFrame([(1, "a b a b", 2.5), (2, None, 1.0), (3, "", None), (4, "b", None), (5, "é é ü", 0.0)], "k long, text string, x double")
    s = Settings(pattern=LETTER_WORD, ngram_size=3)

    def told(s):
        return {tuple(r) for r in dic.row_terms(rows, "k", "text", s, carry=("x",)).collect()}

    whole = told(s)
    assert whole == {(1, 2.5, "a", 2), (1, 2.5, "b", 2), (1, 2.5, "a b", 2), (1, 2.5, "b a", 1), (1, 2.5, "a b a", 1), (1, 2.5, "b a b", 1),
                     (4, None, "b", 1), (5, 0.0, "é", 2), (5, 0.0, "ü", 1), (5, 0.0, "é é", 1), (5, 0.0, "é ü", 1), (5, 0.0, "é é ü", 1)}
    assert dic.row_terms(rows, "k", "text", s).columns == ["k", "ngram", "c"]
    assert "MapInArrow" in plan(dic.row_terms(rows, "k", "text", s))           # counted a batch at a time, not by lambdas
    monkeypatch.setattr(dic, "TASK_WORDS", 2)
    assert told(s) == whole
    monkeypatch.undo()
    blanks = Settings(pattern="[a-z]+( [a-z])?", ngram_size=2)                 # the word "a b" and the n-gram "a", "b"
    assert {(r["ngram"], r["c"]) for r in dic.row_terms(spark.createDataFrame([(1, "a b,a,b")], "k long, text string"), "k", "text", blanks).collect()} == \
        {("a b", 2), ("a", 1), ("b", 1), ("a b a", 1)}

"""Dictionary, terms and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from polarity.operators.dictionary import (build_dictionary, ngram_counts, ngram_docfreq,
                                           refresh_idf, terms)
from polarity.operators.ids import dense_ids
from polarity.operators.packed import collect_parts
from polarity.operators.vectors import (explode_vectors, join_dealt, lookup_terms, score_space, vector_space)
from polarity.plans import testbed as tb
from polarity.queries.registry import (dict_sql, dict_stats_sql, register, terms_sql, with_ctes,
                                       words_sql, ngrams_sql)
from polarity.session import packed_partitions

N = tb.WORDS.ngram_size
CORPUS = ("corpus", tb.CORPUS_SQL)
TERMS = ("terms", terms_sql("corpus", carry="emotion", n=N))
STATS = ("stats", dict_stats_sql("terms"))
DICT = ("dict", dict_sql("stats", "corpus"))
UNSCORED_SQL = ("SELECT CAST(d.doc_id AS VARCHAR) AS guid, d.text FROM documents d "
                "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")


def _corpus(spark, sf):
    return tb.corpus(spark, sf)


def _unscored(spark, sf):
    docs = tb.table(spark, sf, "documents")
    labs = tb.table(spark, sf, "labels").select("doc_id")
    return (docs.join(labs, "doc_id", "left_anti")
            .select(F.col("doc_id").cast("string").alias("guid"), "text"))


def dictionary(spark, sf):
    return build_dictionary(_corpus(spark, sf), tb.WORDS)


@register("build_dictionary", with_ctes(CORPUS, TERMS, STATS, DICT, select="SELECT * FROM dict"))
def q_build_dictionary(spark, sf):
    return dictionary(spark, sf)


@register("ngrams", with_ctes(
    ("w", f"SELECT doc_id, {words_sql('text')} AS w FROM documents"),
    select=f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, "
           f"CAST(len({ngrams_sql('w', N)}) AS BIGINT) AS n_ngrams, "
           f"CAST(len(list_distinct({ngrams_sql('w', N)})) AS BIGINT) AS n_distinct FROM w"))
def q_ngrams(spark, sf):
    from polarity.functions.text import ngrams, words
    d = tb.table(spark, sf, "documents").select("doc_id", words("text", tb.WORDS.pattern).alias("w"))
    w = F.col("w")
    g = ngrams(w, N)
    return d.select("doc_id", F.size(w).cast("bigint").alias("n_words"),
                    F.size(g).cast("bigint").alias("n_ngrams"),
                    F.size(F.array_distinct(g)).cast("bigint").alias("n_distinct"))


@register("term_counts", with_ctes(CORPUS, TERMS, select="SELECT doc_id, ngram, c FROM terms"))
def q_term_counts(spark, sf):
    return terms(_corpus(spark, sf), "doc_id", "text", tb.WORDS)


@register("ngram_counts", with_ctes(CORPUS, TERMS, select=(
    "SELECT ngram, CAST(sum(CASE WHEN emotion >= 0 THEN c ELSE 0 END) AS BIGINT) AS in_texts_p, "
    "CAST(sum(CASE WHEN emotion < 0 THEN c ELSE 0 END) AS BIGINT) AS in_texts_n FROM terms GROUP BY ngram")))
def q_ngram_counts(spark, sf):
    t = terms(_corpus(spark, sf), "doc_id", "text", tb.WORDS, carry=("emotion",))
    return ngram_counts(t)


@register("ngram_docfreq", with_ctes(CORPUS, TERMS, select=(
    "SELECT ngram, count_if(emotion >= 0) AS texts_with_p, count_if(emotion < 0) AS texts_with_n "
    "FROM terms GROUP BY ngram")))
def q_ngram_docfreq(spark, sf):
    t = terms(_corpus(spark, sf), "doc_id", "text", tb.WORDS, carry=("emotion",))
    return ngram_docfreq(t)


@register("dense_ids", with_ctes(
    ("s", "SELECT DISTINCT source FROM documents"),
    select="SELECT CAST(row_number() OVER (ORDER BY source) AS BIGINT) AS source_id, source FROM s"))
def q_dense_ids(spark, sf):
    s = tb.table(spark, sf, "documents").select("source").distinct()
    return dense_ids(s, "source", "source_id")


@register("idf", with_ctes(CORPUS, TERMS, STATS, select=(
    "SELECT n_gramm, round(ln((SELECT count(*) FROM corpus) / (texts_with_p + texts_with_n)), 6) AS idf "
    "FROM stats")))
def q_idf(spark, sf):
    from polarity.operators.dictionary import dictionary_stats
    c = _corpus(spark, sf)
    t = terms(c, "doc_id", "text", tb.WORDS, carry=("emotion",))
    n = c.select(F.count(F.lit(1))).scalar()
    return dictionary_stats(t, n).select(F.col("ngram").alias("n_gramm"), "idf")


@register("idf_refresh", with_ctes(CORPUS, TERMS, STATS, DICT, select=(
    "SELECT n_gramm_id, round(ln((SELECT count(*) FROM documents) / (texts_with_p + texts_with_n)), 6) AS idf "
    "FROM dict")))
def q_idf_refresh(spark, sf):
    """Refresh the idf of a stored dictionary for a larger corpus (all documents)."""
    n = tb.table(spark, sf, "documents").select(F.count(F.lit(1))).scalar()
    return refresh_idf(dictionary(spark, sf), n).select("n_gramm_id", "idf")


MATCHED = ("matched", "SELECT t.doc_id, t.emotion, d.n_gramm_id AS id, t.c, d.idf "
                      "FROM terms t JOIN dict d ON t.ngram = d.n_gramm")
PER = ("per", "SELECT doc_id, count(*) AS m, sqrt(sum(idf * idf)) AS d FROM matched GROUP BY doc_id")


def _vectors_exploded(spark, sf, settings):
    v = vector_space(_corpus(spark, sf), dictionary(spark, sf), settings)
    e = explode_vectors(v, "doc_id", extra=("target",))
    return e.select("doc_id", "target", "idx", F.round("val", 6).alias("val"))


@register("vectors", with_ctes(CORPUS, TERMS, STATS, DICT, MATCHED, PER, select=(
    "SELECT m.doc_id, m.emotion AS target, m.id AS idx, round(m.idf * m.c / p.m * p.d, 6) AS val "
    "FROM matched m JOIN per p ON m.doc_id = p.doc_id")))
def q_vectors(spark, sf):
    return _vectors_exploded(spark, sf, tb.WORDS)


@register("tfidf", with_ctes(CORPUS, TERMS, STATS, DICT, MATCHED, PER, select=(
    "SELECT m.doc_id, m.id AS idx, round(m.idf * m.c / p.m * p.d, 6) AS val "
    "FROM matched m JOIN per p ON m.doc_id = p.doc_id")))
def q_tfidf(spark, sf):
    return _vectors_exploded(spark, sf, tb.WORDS).select("doc_id", "idx", "val")


@register("idf_only", with_ctes(CORPUS, TERMS, STATS, DICT, MATCHED, PER, select=(
    "SELECT m.doc_id, CASE WHEN m.emotion >= 0 THEN 1 ELSE -1 END AS target, m.id AS idx, "
    "round(m.idf * p.d, 6) AS val FROM matched m JOIN per p ON m.doc_id = p.doc_id")))
def q_idf_only(spark, sf):
    """Weights without tf, two-class targets."""
    from polarity.config import Settings, LETTER_WORD
    s = Settings(pattern=LETTER_WORD, use_tf=False, n_classes=2)
    return _vectors_exploded(spark, sf, s)


@register("tf", with_ctes(CORPUS, TERMS, STATS, DICT, MATCHED, PER, select=(
    "SELECT m.doc_id, m.id AS idx, round(m.c / p.m, 6) AS tf FROM matched m JOIN per p ON m.doc_id = p.doc_id")))
def q_tf(spark, sf):
    c = _corpus(spark, sf)
    t = terms(c, "doc_id", "text", tb.WORDS)
    mt = lookup_terms(t, dictionary(spark, sf))
    per = collect_parts(mt.select("doc_id", "id", "c"), ["doc_id"], packed_partitions(mt))
    return per.select("doc_id", "n_terms", F.inline("_t")).select("doc_id", F.col("id").alias("idx"),
                                                                  F.round(F.col("c") / F.col("n_terms"), 6).alias("tf"))


@register("text_norm", with_ctes(CORPUS, TERMS, STATS, DICT, MATCHED, select=(
    "SELECT c.doc_id, CAST(count(m.id) AS INTEGER) AS n_terms, round(coalesce(sqrt(sum(m.idf * m.idf)), 0), 6) AS norm "
    "FROM corpus c LEFT JOIN matched m ON c.doc_id = m.doc_id GROUP BY c.doc_id")))
def q_text_norm(spark, sf):
    v = vector_space(_corpus(spark, sf), dictionary(spark, sf), tb.WORDS)
    return v.select("doc_id", "n_terms", F.round("norm", 6).alias("norm"))


@register("dictionary_lookup", with_ctes(
    CORPUS, TERMS, STATS, DICT,
    ("unscored", UNSCORED_SQL),
    ("st", terms_sql("unscored", key="guid", n=N)),
    select="SELECT s.guid, d.n_gramm_id AS id, s.c FROM st s JOIN dict d ON s.ngram = d.n_gramm"))
def q_dictionary_lookup(spark, sf):
    t = terms(_unscored(spark, sf), "guid", "text", tb.WORDS)
    return lookup_terms(t, dictionary(spark, sf)).select("guid", "id", "c")


@register("oov_rate", with_ctes(
    CORPUS, TERMS, STATS, DICT,
    ("unscored", UNSCORED_SQL),
    ("st", terms_sql("unscored", key="guid", n=N)),
    select=("SELECT u.guid, CAST(count(s.ngram) AS BIGINT) AS n_terms, "
            "CAST(count(d.n_gramm) AS BIGINT) AS n_known, "
            "round(CASE WHEN count(s.ngram) = 0 THEN 0 ELSE 1 - count(d.n_gramm) / count(s.ngram) END, 6) AS oov_rate "
            "FROM unscored u LEFT JOIN st s ON u.guid = s.guid LEFT JOIN dict d ON s.ngram = d.n_gramm "
            "GROUP BY u.guid")))
def q_oov_rate(spark, sf):
    """share of a text's distinct n-grams missing from the dictionary."""
    u = _unscored(spark, sf)
    t = terms(u, "guid", "text", tb.WORDS)
    d = dictionary(spark, sf).select(F.col("n_gramm").alias("ngram"), F.lit(1).alias("_k"))
    per = join_dealt(t, d, "ngram", "left").groupBy("guid").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count("_k").alias("n_known"))
    out = u.select("guid").join(per, "guid", "left").select(
        "guid", F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"),
        F.coalesce("n_known", F.lit(0)).cast("bigint").alias("n_known"))
    return out.withColumn("oov_rate", F.round(
        F.when(F.col("n_terms") == 0, F.lit(0.0))
        .otherwise(1 - F.col("n_known") / F.col("n_terms")), 6))


@register("serving_vectors", with_ctes(
    CORPUS, TERMS, STATS, DICT,
    ("unscored", UNSCORED_SQL),
    ("st", terms_sql("unscored", key="guid", n=N)),
    ("sm", "SELECT s.guid, d.n_gramm_id AS id, s.c, d.idf FROM st s JOIN dict d ON s.ngram = d.n_gramm"),
    ("sp", "SELECT guid, count(*) AS m, sqrt(sum(idf * idf)) AS d FROM sm GROUP BY guid"),
    select=("SELECT u.guid, CAST(coalesce(sp.m, 0) AS INTEGER) AS n_terms, sm.id AS idx, "
            "round(sm.idf * sm.c / sp.m * sp.d, 6) AS val "
            "FROM unscored u LEFT JOIN sm ON u.guid = sm.guid LEFT JOIN sp ON u.guid = sp.guid")))
def q_serving_vectors(spark, sf):
    """M2 in exploded form; a text without known n-grams keeps one row with null idx/val."""
    v = score_space(_unscored(spark, sf), dictionary(spark, sf), tb.WORDS)
    z = F.explode_outer(F.arrays_zip("idx", "val")).alias("_e")
    return v.select("guid", "n_terms", z).select(
        "guid", "n_terms", F.col("_e.idx").alias("idx"), F.round(F.col("_e.val"), 6).alias("val"))

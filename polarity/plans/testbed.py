"""Mapping of the generic test tables onto the shapes the engine works on.

The test tables (documents, labels, events, embeddings, ...) carry no polarity labels, dates or
sources of their own, so fixed rules derive them.  Each rule has a DataFrame form (used by the
queries) and the same rule as SQL (used by the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarity.config import ACCENTED_WORD, LETTER_WORD, Settings

# Fixed parameters of the registered queries.
WORDS = Settings(pattern=LETTER_WORD)                 # test tables hold Latin script
WORDS_NO_TF = Settings(pattern=LETTER_WORD, use_tf=False)
WORDS_TWO = Settings(pattern=LETTER_WORD, n_classes=2)
ACCENTED = ACCENTED_WORD
WATERMARK = "2024-01-15 00:00:00"                      # unscored scan: date >= watermark
CATEGORY = "fr"                                        # category scan / trend words
SOURCE_TYPES = ("news", "np-news")                     # source filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emotion(toxic="toxic", quality="quality") -> Column:
    """Five-class label from (toxic, quality): (0,1)->1, (0,0)->0, (1,1)->-1, (1,0)->-2."""
    t, q = F.col(toxic), F.col(quality)
    return (F.when((t == 0) & (q == 1), 1).when((t == 0) & (q == 0), 0)
            .when((t == 1) & (q == 1), -1).when((t == 1) & (q == 0), -2)).cast("int")


EMOTION_SQL = ("CAST(CASE WHEN toxic = 0 AND quality = 1 THEN 1 WHEN toxic = 0 AND quality = 0 THEN 0 "
               "WHEN toxic = 1 AND quality = 1 THEN -1 WHEN toxic = 1 AND quality = 0 THEN -2 END AS INTEGER)")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: (doc_id, text, emotion)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labs = table(spark, sf_dir, "labels").select("doc_id", emotion().alias("emotion"))
    return docs.join(labs, "doc_id").where(F.col("emotion").isNotNull())


CORPUS_SQL = (f"SELECT d.doc_id, d.text, {EMOTION_SQL} AS emotion FROM documents d "
              f"JOIN labels l ON d.doc_id = l.doc_id WHERE {EMOTION_SQL} IS NOT NULL")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news table: guid, text_id, date, myemote (human label, nullable), temote (machine
    label, null = unscored), title (first line), text, source_id, category.

    date = ts of event doc_id * floor(#events / #documents), which spreads the texts over the
    whole event period.
    """
    docs = table(spark, sf_dir, "documents")
    ev_all = table(spark, sf_dir, "events")
    k = F.floor(ev_all.select(F.count(F.lit(1))).scalar() / docs.select(F.count(F.lit(1))).scalar())
    docs = docs.withColumn("_ek", F.col("doc_id") * k)
    labs = table(spark, sf_dir, "labels").select("doc_id", emotion().alias("myemote"))
    ev = ev_all.select(F.col("event_id").alias("_ek"), F.col("ts").alias("date"))
    return (docs.join(labs, "doc_id", "left").join(ev, "_ek", "left")
            .select(F.col("doc_id").cast("string").alias("guid"),
                    F.col("doc_id").alias("text_id"), "date", "myemote",
                    F.lit(None).cast("int").alias("temote"),
                    F.substring_index("text", "\n", 1).alias("title"), "text",
                    F.col("source").alias("source_id"), F.col("lang").alias("category")))


NEWS_SQL = (f"SELECT CAST(d.doc_id AS VARCHAR) AS guid, d.doc_id AS text_id, e.ts AS date, "
            f"{EMOTION_SQL} AS myemote, CAST(NULL AS INTEGER) AS temote, "
            f"split_part(d.text, chr(10), 1) AS title, d.text, d.source AS source_id, "
            f"d.lang AS category FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
            f"LEFT JOIN events e ON e.event_id = d.doc_id * "
            f"CAST(floor((SELECT count(*) FROM events) / (SELECT count(*) FROM documents)) AS BIGINT)")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources(id, type): type by the source number: 0 -> news, 1 -> np-news, 2 -> blog (mod 3)."""
    docs = table(spark, sf_dir, "documents")
    num = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3
    return (docs.select("source").distinct()
            .select(F.col("source").alias("id"),
                    F.when(num == 0, "news").when(num == 1, "np-news").otherwise("blog")
                    .alias("type")))


SOURCES_SQL = ("SELECT source AS id, CASE CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 3 "
               "WHEN 0 THEN 'news' WHEN 1 THEN 'np-news' ELSE 'blog' END AS type "
               "FROM (SELECT DISTINCT source FROM documents)")


# ---------------------------------------------------------------- word tables derived by rule

def _lemma(form: Column) -> Column:
    low = F.lower(form)
    return F.when((F.length(form) > 3) & low.endswith("s"),
                  F.expr("substring(lower(form), 1, length(form) - 1)")).otherwise(low)


def _pos(form: Column) -> Column:
    low = F.lower(form)
    return (F.when(F.length(form) <= 3, F.lit("FUNC"))
            .when(low.endswith("ment") | low.endswith("ly"), F.lit("ADV"))
            .otherwise(F.lit("NOUN")))


LEMMA_SQL = ("CASE WHEN length(form) > 3 AND suffix(lower(form), 's') "
             "THEN substring(lower(form), 1, length(form) - 1) ELSE lower(form) END")
POS_SQL = ("CASE WHEN length(form) <= 3 THEN 'FUNC' WHEN suffix(lower(form), 'ment') "
           "OR suffix(lower(form), 'ly') THEN 'ADV' ELSE 'NOUN' END")


def lemma_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, lemma, pos) for every word form of the documents: lemma = lower case without a
    final 's' (forms longer than 3), pos = FUNC (<= 3 letters), ADV (-ment, -ly), else NOUN."""
    from polarity.functions.text import words
    docs = table(spark, sf_dir, "documents")
    forms = docs.select(F.explode(words("text", LETTER_WORD)).alias("form")).distinct()
    return forms.select("form", _lemma(F.col("form")).alias("lemma"), _pos(F.col("form")).alias("pos"))


def lemma_dict_sql() -> str:
    return (f"SELECT form, {LEMMA_SQL} AS lemma, {POS_SQL} AS pos FROM (SELECT DISTINCT "
            f"unnest(regexp_extract_all(text, '({LETTER_WORD})', 1)) AS form FROM documents)")


def texts_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(guid, temote): labelled documents already carry their label as score, others null."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labs = table(spark, sf_dir, "labels").select("doc_id", emotion().alias("temote"))
    return docs.join(labs, "doc_id", "left").select(F.col("doc_id").cast("string").alias("guid"),
                                                    "temote")


TEXTS_WITH_SCORES_SQL = (f"SELECT CAST(d.doc_id AS VARCHAR) AS guid, {EMOTION_SQL} AS temote "
                         f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


def new_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(guid, seq, label): the events as a stream of scores; doc = event_id mod #documents,
    seq = ts, label = floor(value) mod 5 - 2."""
    n = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    ev = table(spark, sf_dir, "events")
    return ev.select((F.col("event_id") % n).cast("string").alias("guid"), F.col("ts").alias("seq"),
                     ((F.floor("value").cast("bigint") % 5) - 2).cast("int").alias("label"))


NEW_SCORES_SQL = ("SELECT CAST(event_id % (SELECT count(*) FROM documents) AS VARCHAR) AS guid, ts AS seq, "
                  "CAST(CAST(floor(value) AS BIGINT) % 5 - 2 AS INTEGER) AS label "
                  "FROM events")


def predictions(df: DataFrame, key: str = "n_chars") -> Column:
    """A deterministic stand-in prediction in -2..2 for metric queries: n_chars mod 5 - 2."""
    return ((F.col(key) % 5) - 2).cast("int")


PREDICTION_SQL = "CAST(n_chars % 5 - 2 AS INTEGER)"

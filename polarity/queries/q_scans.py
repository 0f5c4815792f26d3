"""Scans, filters, joins, sinks-as-tables and bookkeeping (S1-S4, S11, S13, F4, F5, J1, J2, J5,
K2, K8, K12, K13, A6, A7, A12-A14, A19, O1, O4, T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polarity.operators.audit import by_source, export_clean, lookup, lookup_list, text_audit
from polarity.operators.scoring import batch_report, last_label, route_errors, upsert_scores
from polarity.operators.trends import categories
from polarity.config import Settings
from polarity.plans import testbed as tb
from polarity.plans.jobs import audit, audit_list
from polarity.queries.registry import register, with_ctes, words_sql
from polarity.session import scratch_path
from polarity.sources.sinks import append_corpus, write_corpus
from polarity.sources.tables import (load_table, newest_date, ordered, scan_category, scan_labelled,
                                     scan_labelled_since, scan_queue, scan_unscored, table_size)
from polarity.streaming.poll import poll_available

NEWS = ("news", tb.NEWS_SQL)


def _news(spark, sf):
    return tb.news(spark, sf)


@register("labelled_scan", with_ctes(NEWS, select="SELECT text_id, text, myemote, date FROM news WHERE myemote IS NOT NULL"))
def q_labelled_scan(spark, sf):
    return scan_labelled(_news(spark, sf)).select("text_id", "text", "myemote", "date")


@register("labelled_incremental", with_ctes(
    NEWS, ("stored", "SELECT * FROM news WHERE myemote IS NOT NULL AND date < TIMESTAMP '2024-01-15'"),
    select=("SELECT text_id, myemote, date FROM news WHERE myemote IS NOT NULL AND "
            "((SELECT max(date) FROM stored) IS NULL OR date > (SELECT max(date) FROM stored))")))
def q_labelled_incremental(spark, sf):
    """The stored corpus is the labelled texts before 15 Jan; fetch labelled texts newer
    than its newest date."""
    n = _news(spark, sf)
    stored = n.where(F.col("myemote").isNotNull() & (F.col("date") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return scan_labelled_since(n, stored).select("text_id", "myemote", "date")


@register("unscored_scan", with_ctes(
    NEWS, select=f"SELECT text_id, date FROM news WHERE temote IS NULL AND date >= TIMESTAMP '{tb.WATERMARK}'"))
def q_unscored_scan(spark, sf):
    return scan_unscored(_news(spark, sf), tb.WATERMARK).select("text_id", "date")


@register("poll_stream", with_ctes(NEWS, select=(
    f"SELECT text_id, date, CASE WHEN date < TIMESTAMP '{tb.WATERMARK}' OR date IS NULL THEN 0 ELSE 1 END AS batch FROM news WHERE temote IS NULL")))
def q_poll_stream(spark, sf):
    """T4: the news table polled as a stream, first as it was at the watermark, then whole, until nothing is new."""
    out, days = scratch_path(spark, "polled"), [F.col("date").isNull() | (F.col("date") < F.lit(tb.WATERMARK).cast("timestamp_ntz"))]

    def read(session):
        news = _news(session, sf)
        return news.where(days.pop()) if days else news

    def handle(rows, batch):
        rows.select("text_id", "date").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    poll_available(spark, read, handle, scratch_path(spark, "poll"))
    return spark.read.schema("text_id long, date timestamp_ntz, batch int").parquet(out)


@register("limited_scan", with_ctes(
    NEWS, select=(f"SELECT text_id, date FROM news WHERE temote IS NULL AND date >= TIMESTAMP '{tb.WATERMARK}' "
                  "ORDER BY date, text_id LIMIT 100")))
def q_limited_scan(spark, sf):
    """S3 + O4 with texts_limit = 100 (the limit is the feature)."""
    return scan_unscored(_news(spark, sf), tb.WATERMARK, limit=100).select("text_id", "date")


QUEUE_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents"
SCORED_SQL = f"SELECT CAST(d.doc_id AS VARCHAR) AS id, {tb.EMOTION_SQL} AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _queue(spark, sf):
    d = tb.table(spark, sf, "documents")
    queue = d.select(F.col("doc_id").cast("string").alias("id"), "text")
    texts = tb.texts_with_scores(spark, sf).select(F.col("guid").alias("id"), F.col("temote").alias("score"))
    return queue, texts


@register("queue_scan", with_ctes(("queue", QUEUE_SQL), ("texts", SCORED_SQL), select=(
    "SELECT q.id, q.text FROM queue q JOIN texts t ON q.id = t.id WHERE t.score IS NULL ORDER BY q.id LIMIT 500")))
def q_queue_scan(spark, sf):
    """S4 + J1 with a limit of 500: queue rows whose text has no score yet."""
    queue, texts = _queue(spark, sf)
    return scan_queue(queue, texts, 500)


@register("queue_all", QUEUE_SQL)
def q_queue_all(spark, sf):
    """S4 without a limit: the whole queue."""
    queue, texts = _queue(spark, sf)
    return scan_queue(queue, texts, None)


@register("category_scan", with_ctes(NEWS, select=(
    f"SELECT text_id, concat_ws(' ', title, text) AS content FROM news WHERE category = '{tb.CATEGORY}'")))
def q_category_scan(spark, sf):
    return scan_category(_news(spark, sf), tb.CATEGORY).select("text_id", "content")


@register("category_titles", with_ctes(NEWS, select=(
    f"SELECT text_id, title AS content FROM news WHERE category = '{tb.CATEGORY}'")))
def q_category_titles(spark, sf):
    return scan_category(_news(spark, sf), tb.CATEGORY, with_text=False).select("text_id", "content")


@register("load_table", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 1000")
def q_load_table(spark, sf):
    """Generic source scan; the filter and the column list reach the parquet reader."""
    d = load_table(spark, "parquet", f"{sf}/documents.parquet")
    return d.where(F.col("n_chars") > 1000).select("doc_id", "lang", "source", "n_chars")


@register("lookup_key", with_ctes(NEWS, select="SELECT guid, text_id, date FROM news WHERE CAST(date AS DATE) = DATE '2024-01-05'"))
def q_lookup_key(spark, sf):
    """F4 by date: every text of one day."""
    return lookup(_news(spark, sf), date="2024-01-05").select("guid", "text_id", "date")


@register("lookup_guid", with_ctes(NEWS, select="SELECT guid, text_id, title FROM news WHERE guid = '7'"))
def q_lookup_guid(spark, sf):
    """F4 by guid (a single key lookup is the feature)."""
    return lookup(_news(spark, sf), guid="7").select("guid", "text_id", "title")


@register("source_filter", with_ctes(NEWS, ("sources", tb.SOURCES_SQL), select=(
    f"SELECT n.text_id, n.source_id FROM news n WHERE n.category = '{tb.CATEGORY}' AND n.source_id IN "
    "(SELECT id FROM sources WHERE type IN ('news', 'np-news'))")))
def q_source_filter(spark, sf):
    return by_source(_news(spark, sf), tb.sources(spark, sf), tb.SOURCE_TYPES, tb.CATEGORY).select(
        "text_id", "source_id")


@register("lookup_list", with_ctes(NEWS, select=(
    "SELECT guid, text_id FROM news WHERE guid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)")))
def q_lookup_list(spark, sf):
    """The key list is the ids of the toxic-labelled texts."""
    keys = tb.table(spark, sf, "labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").cast("string").alias("value"))
    return lookup_list(_news(spark, sf), keys).select("guid", "text_id")


@register("ordered_texts", with_ctes(("corpus", tb.CORPUS_SQL), select="SELECT doc_id, emotion FROM corpus ORDER BY doc_id"))
def q_ordered_texts(spark, sf):
    return ordered(tb.corpus(spark, sf).select("doc_id", "emotion"), "doc_id")


@register("table_size", "SELECT count(*) AS n_rows FROM documents")
def q_table_size(spark, sf):
    return table_size(tb.table(spark, sf, "documents"))


@register("newest_date", with_ctes(NEWS, select="SELECT max(date) AS newest FROM news WHERE myemote IS NOT NULL"))
def q_newest_date(spark, sf):
    """Newest date of the labelled texts (nulls ignored)."""
    return newest_date(_news(spark, sf), label="myemote")


def _audit_sql(text: str) -> str:
    return (f"SELECT count(*) AS texts, count_if({text} IS NOT NULL AND {text} <> '' AND "
            f"len(regexp_extract_all({text}, '({tb.ACCENTED})', 1)) = 0) AS foreign_texts, "
            f"count_if({text} IS NULL OR {text} = '') AS empty_texts")


@register("text_audit", _audit_sql("text") + " FROM documents")
def q_text_audit(spark, sf):
    return text_audit(tb.table(spark, sf, "documents"), "text", tb.ACCENTED)


_TOXIC = "(SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"


def _toxic_keys(spark, sf):
    return tb.table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").cast("string").alias("value"))


@register("audit_chosen", with_ctes(NEWS, select=_audit_sql("text") + f" FROM news WHERE guid IN {_TOXIC}"))
def q_audit_chosen(spark, sf):
    """P10 by key list: the counts of the texts labelled toxic."""
    return audit(tb.news(spark, sf), Settings(pattern=tb.ACCENTED), keys=_toxic_keys(spark, sf))


@register("audit_list", with_ctes(NEWS, select=(
    f"SELECT guid, text_id, date, myemote, title, array_to_string(coalesce(regexp_extract_all(text, '({tb.ACCENTED})', 1), []), ' ') AS clean_text, "
    f"CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN len(regexp_extract_all(text, '({tb.ACCENTED})', 1)) = 0 THEN 'foreign' ELSE 'ok' END AS state "
    f"FROM news WHERE guid IN {_TOXIC}")))
def q_audit_list(spark, sf):
    """P10 by key list: the texts labelled toxic with their words and state."""
    return audit_list(tb.news(spark, sf), Settings(pattern=tb.ACCENTED), keys=_toxic_keys(spark, sf)).select(
        "guid", "text_id", "date", "myemote", "title", "clean_text", "state")


@register("text_audit_by_lang", "SELECT lang, " + _audit_sql("text")[len("SELECT "):] + " FROM documents GROUP BY lang")
def q_text_audit_by_lang(spark, sf):
    return text_audit(tb.table(spark, sf, "documents"), "text", tb.ACCENTED, by="lang")


@register("categories", "SELECT lang AS category, count(*) AS n_texts FROM documents GROUP BY lang")
def q_categories(spark, sf):
    return categories(tb.table(spark, sf, "documents").withColumnRenamed("lang", "category"))


@register("last_label", f"SELECT guid, arg_max(label, (seq, label)) AS label FROM ({tb.NEW_SCORES_SQL}) GROUP BY guid")
def q_last_label(spark, sf):
    return last_label(tb.new_scores(spark, sf))


@register("score_writeback", with_ctes(
    ("texts", tb.TEXTS_WITH_SCORES_SQL),
    ("s", f"SELECT guid, arg_max(label, (seq, label)) AS label FROM ({tb.NEW_SCORES_SQL}) GROUP BY guid"),
    select="SELECT t.guid, coalesce(s.label, t.temote) AS temote FROM texts t LEFT JOIN s ON t.guid = s.guid"))
def q_score_writeback(spark, sf):
    """K8: new scores (last one per key wins) written back over the texts by key."""
    return upsert_scores(tb.texts_with_scores(spark, sf), tb.new_scores(spark, sf))


@register("error_route", f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' ELSE 'foreign' END AS reason "
                         f"FROM documents WHERE text IS NULL OR text = '' OR "
                         f"len(regexp_extract_all(text, '({tb.ACCENTED})', 1)) = 0")
def q_error_route(spark, sf):
    d = tb.table(spark, sf, "documents")
    _, bad = route_errors(d, "doc_id", "text", tb.ACCENTED)
    return bad


@register("clean_export", with_ctes(NEWS, ("sources", tb.SOURCES_SQL), select=(
    f"SELECT guid, array_to_string({words_sql('text')}, ' ') AS clean_text FROM news "
    f"WHERE category = '{tb.CATEGORY}' AND source_id IN (SELECT id FROM sources WHERE type IN ('news', 'np-news'))")))
def q_clean_export(spark, sf):
    """Cleaned texts of the chosen sources and category, with their guid."""
    sel = by_source(_news(spark, sf), tb.sources(spark, sf), tb.SOURCE_TYPES, tb.CATEGORY)
    return export_clean(sel, "guid", "text", tb.WORDS.pattern)


@register("append_ids", with_ctes(
    NEWS,
    ("old", "SELECT text_id, date FROM news WHERE myemote IS NOT NULL AND date < TIMESTAMP '2024-01-15'"),
    ("ids", "SELECT text_id, row_number() OVER (ORDER BY text_id) AS corpus_id FROM old"),
    ("new", "SELECT text_id FROM news WHERE myemote IS NOT NULL AND date >= TIMESTAMP '2024-01-15'"),
    select=("SELECT text_id, CAST(corpus_id AS BIGINT) AS corpus_id FROM ids UNION ALL "
            "SELECT text_id, CAST((SELECT coalesce(max(corpus_id), 0) FROM ids) + "
            "row_number() OVER (ORDER BY text_id) AS BIGINT) AS corpus_id FROM new")))
def q_append_ids(spark, sf):
    """K2: the corpus holds the labelled texts before 15 Jan with ids 1..N; newer labelled texts
    are appended with ids N+1.. in text_id order."""
    n = _news(spark, sf).where(F.col("myemote").isNotNull())
    day = F.lit("2024-01-15").cast("timestamp_ntz")
    path = scratch_path(spark, "append-ids")
    write_corpus(n.where(F.col("date") < day).select("text_id"), path)
    append_corpus(n.where(F.col("date") >= day).select("text_id"), path)
    return spark.read.parquet(path).select("text_id", "corpus_id")


@register("batch_report", with_ctes(
    ("unscored", "SELECT CAST(d.doc_id AS VARCHAR) AS guid, d.text FROM documents d "
                 "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    select=(f"SELECT count(*) AS texts, count_if(text IS NULL OR text = '' OR "
            f"len(regexp_extract_all(text, '({tb.ACCENTED})', 1)) = 0) AS errors, "
            f"count_if(text IS NOT NULL AND text <> '' AND len(regexp_extract_all(text, '({tb.ACCENTED})', 1)) > 0) "
            f"AS scores FROM unscored")))
def q_batch_report(spark, sf):
    """A19 for a scoring batch over the unscored texts: handled, routed to errors, scored."""
    d = tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    good, bad = route_errors(d, "doc_id", "text", tb.ACCENTED)
    return batch_report(d, bad, good)

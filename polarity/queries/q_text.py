"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from polarity.config import LETTER_WORD
from polarity.functions.text import (parse_message, prefix_number, split_list, stamp,
                                     strip_markup, text_state, words)
from polarity.functions.vecmath import euclidean, manhattan
from polarity.operators.lemma import lemmatise
from polarity.operators.vectors import target
from polarity.plans import testbed as tb
from polarity.queries.registry import register, with_ctes, words_sql

NUM_RE = r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))"


def _num_sql(s: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({s}, '{NUM_RE}', 1) AS DOUBLE), 0.0)"


@register("clean_words", f"SELECT doc_id, array_to_string({words_sql('text')}, ' ') AS clean_text, "
                         f"CAST(len({words_sql('text')}) AS INTEGER) AS n_words FROM documents")
def q_clean_words(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", words("text", LETTER_WORD).alias("w"))
    return d.select("doc_id", F.array_join("w", " ").alias("clean_text"),
                    F.size("w").alias("n_words"))


@register("strip_markup", f"SELECT doc_id, array_to_string(regexp_extract_all(markup, '({LETTER_WORD})', 1), ' ') "
                          f"AS stripped FROM (SELECT doc_id, array_to_string(list_transform({words_sql('text')}, "
                          f"lambda x: '{{' || lower(x) || '}}'), '') AS markup FROM documents)")
def q_strip_markup(spark, sf):
    """F2 on lemmatiser-style output '{lemma}{lemma}...' built from the words."""
    d = tb.table(spark, sf, "documents").select("doc_id", words("text", LETTER_WORD).alias("w"))
    m = d.select("doc_id", F.array_join(F.transform("w", lambda x: F.concat(F.lit("{"), F.lower(x), F.lit("}"))), "")
                 .alias("markup"))
    return m.select("doc_id", strip_markup("markup", LETTER_WORD).alias("stripped"))


def _state_sql(text: str) -> str:
    return (f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'empty' "
            f"WHEN len(regexp_extract_all({text}, '({tb.ACCENTED})', 1)) = 0 THEN 'foreign' ELSE 'ok' END")


@register("text_state", f"SELECT doc_id, {_state_sql('text')} AS state FROM documents")
def q_text_state(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", text_state("text", tb.ACCENTED).alias("state"))


@register("target_map", f"SELECT doc_id, emotion, CASE WHEN emotion >= 0 THEN 1 ELSE -1 END AS target2, "
                        f"emotion AS target5 FROM ({tb.CORPUS_SQL})")
def q_target_map(spark, sf):
    c = tb.corpus(spark, sf)
    return c.select("doc_id", "emotion", target("emotion", 2).alias("target2"),
                    target("emotion", 5).alias("target5"))


@register("split_list", "SELECT doc_id, CAST(len(items) AS INTEGER) AS n_items, "
                        "coalesce(items[1], '') AS first_item FROM (SELECT doc_id, "
                        "list_filter(string_split(text, '.'), lambda x: x <> '') AS items FROM documents)")
def q_split_list(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", split_list("text", ".").alias("items"))
    return d.select("doc_id", F.size("items").alias("n_items"),
                    F.coalesce(F.get("items", F.lit(0)), F.lit("")).alias("first_item"))     # get: a text of separators alone has no item


_K = _num_sql("split_part(props, ':', 2)")
_T = _num_sql("event_type")
_U = _num_sql("' ' || CAST(user_id AS VARCHAR) || event_type")


@register("prefix_number", f"SELECT event_id, {_K} AS k, {_T} AS t, {_U} AS u FROM events")
def q_prefix_number(spark, sf):
    e = tb.table(spark, sf, "events")
    return e.select("event_id", prefix_number(F.split_part("props", F.lit(":"), F.lit(2))).alias("k"),
                    prefix_number("event_type").alias("t"),
                    prefix_number(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.col("event_type")))
                    .alias("u"))


@register("stamp", "SELECT event_id, strftime(ts, '%d.%m.%y-%H:%M:%S') AS stamp FROM events")
def q_stamp(spark, sf):
    return tb.table(spark, sf, "events").select("event_id", stamp("ts").alias("stamp"))


_MSG_SQL = ("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || chr(9) || text AS value "
            "FROM conversations")


@register("parse_message", f"SELECT split_part(value, chr(9), 1) AS id, "
                           f"CASE WHEN strpos(value, chr(9)) = 0 THEN '' ELSE substr(value, strpos(value, chr(9)) + 1) END AS text "
                           f"FROM ({_MSG_SQL})")
def q_parse_message(spark, sf):
    c = tb.table(spark, sf, "conversations")
    v = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
                          F.lit("\t"), F.col("text")).alias("value"))
    return v.select(parse_message("value").alias("m")).select("m.id", "m.text")


_PAIRS_SQL = ("SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a "
              "JOIN embeddings b ON b.vec_id = a.vec_id + 1")


def _pairs(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.select("vec_id", F.col("embedding").alias("x")).join(b, "vec_id")


@register("manhattan", "SELECT vec_id, round(CASE WHEN len(x) = len(y) THEN "
                       "list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(CAST(x[i] AS DOUBLE) - CAST(y[i] AS DOUBLE)))) "
                       f"ELSE 0 END, 6) AS distance FROM ({_PAIRS_SQL})")
def q_manhattan(spark, sf):
    """V8 between each vector and the next id."""
    return _pairs(spark, sf).select("vec_id", F.round(manhattan("x", "y"), 6).alias("distance"))


@register("euclidean", "SELECT vec_id, round(CASE WHEN len(x) = len(y) THEN "
                       "sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (CAST(x[i] AS DOUBLE) - CAST(y[i] AS DOUBLE)) ^ 2))) "
                       f"ELSE 0 END, 6) AS distance FROM ({_PAIRS_SQL})")
def q_euclidean(spark, sf):
    """V9 between each vector and the next id."""
    return _pairs(spark, sf).select("vec_id", F.round(euclidean("x", "y"), 6).alias("distance"))


@register("lemmatise", with_ctes(
    ("ld", tb.lemma_dict_sql()),
    ("w", f"SELECT d.doc_id, u.pos, u.form FROM documents d, LATERAL (SELECT unnest({words_sql('d.text')}) AS form, "
          f"unnest(range(1, len({words_sql('d.text')}) + 1)) AS pos) u"),
    ("lw", "SELECT w.doc_id, w.pos, coalesce(ld.lemma, w.form) AS lemma FROM w LEFT JOIN ld ON w.form = ld.form"),
    ("lt", "SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS lemma_text FROM lw GROUP BY doc_id"),
    select="SELECT d.doc_id, coalesce(lt.lemma_text, '') AS lemma_text FROM documents d LEFT JOIN lt ON d.doc_id = lt.doc_id"))
def q_lemmatise(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", "text")
    return lemmatise(d, tb.lemma_dict(spark, sf), "doc_id", "text", LETTER_WORD, unique=True).select("doc_id", "lemma_text")

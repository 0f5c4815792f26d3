"""Registry of queries and oracle SQL; SQL fragments shared by the oracle strings."""

from __future__ import annotations

import importlib

from polarity.config import LETTER_WORD

QUERIES: dict = {}
ORACLE: dict = {}

_MODULES = ["polarity.queries.q_dictionary", "polarity.queries.q_text", "polarity.queries.q_scans",
            "polarity.queries.q_metrics", "polarity.queries.q_cluster", "polarity.queries.q_trends",
            "polarity.queries.q_model", "polarity.queries.q_files"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLE


# ----------------------------------------------------------------- SQL fragments for DuckDB

def words_sql(text: str, pattern: str = LETTER_WORD) -> str:
    return f"coalesce(regexp_extract_all({text}, '({pattern})', 1), [])"


def ngrams_sql(w: str, n: int) -> str:
    parts = [f"list_transform(range(1, len({w}) - {j} + 2), lambda i: array_to_string({w}[i:i + {j - 1}], ' '))"
             for j in range(1, n + 1)]
    return "flatten([" + ", ".join(parts) + "])"


def terms_sql(src: str, key: str = "doc_id", carry: str = "", n: int = 3,
              pattern: str = LETTER_WORD) -> str:
    c = f", {carry}" if carry else ""
    return (f"SELECT {key}{c}, g AS ngram, count(*) AS c FROM (SELECT {key}{c}, "
            f"unnest({ngrams_sql('w', n)}) AS g FROM (SELECT {key}{c}, {words_sql('text', pattern)} AS w "
            f"FROM {src})) GROUP BY {key}{c}, g")


def dict_stats_sql(terms: str) -> str:
    return ("SELECT ngram AS n_gramm, "
            "CAST(sum(CASE WHEN emotion < 0 THEN c ELSE 0 END) AS BIGINT) AS in_texts_n, "
            "CAST(sum(CASE WHEN emotion >= 0 THEN c ELSE 0 END) AS BIGINT) AS in_texts_p, "
            "count_if(emotion < 0) AS texts_with_n, count_if(emotion >= 0) AS texts_with_p "
            f"FROM {terms} GROUP BY ngram")


def dict_sql(stats: str, corpus: str) -> str:
    return ("SELECT CAST(row_number() OVER (ORDER BY n_gramm) AS BIGINT) AS n_gramm_id, n_gramm, "
            "in_texts_n, in_texts_p, texts_with_n, texts_with_p, "
            f"round(ln((SELECT count(*) FROM {corpus}) / (texts_with_p + texts_with_n)), 6) AS idf "
            f"FROM {stats}")


def with_ctes(*ctes: tuple[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + select

"""op4: every document scored under the trigram counts of all others."""

from pyspark.sql import functions as F

from polarity.llm.common import WORD, table
from polarity.llm.lm import ALPHA, UNSEEN, backoff_scores
from polarity.llm.registry import register

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(list_transform(regexp_extract_all(text, '{WORD}'),
                  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i] AS u, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS b,
      CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS t FROM p),
e AS (SELECT doc_id, i, u AS x FROM g UNION ALL SELECT doc_id, i, b FROM g WHERE b IS NOT NULL
      UNION ALL SELECT doc_id, i, t FROM g WHERE t IS NOT NULL),
o AS (SELECT doc_id, x, count(*) AS own FROM e GROUP BY doc_id, x),
a AS (SELECT doc_id, x, sum(own) OVER (PARTITION BY x) - own AS c FROM o),
s AS (SELECT g.doc_id, g.i, a1.c AS cu, a2.c AS cb, a3.c AS ct,
      lag(a1.c) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS xu, lag(a2.c) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS xb
      FROM g JOIN a a1 ON a1.doc_id = g.doc_id AND a1.x = g.u
      LEFT JOIN a a2 ON a2.doc_id = g.doc_id AND a2.x = g.b LEFT JOIN a a3 ON a3.doc_id = g.doc_id AND a3.x = g.t),
n AS (SELECT d.doc_id, len(w) AS n_words, sum(len(w)) OVER () - len(w) AS others FROM d),
l AS (SELECT s.doc_id, CASE WHEN ct > 0 THEN ln(ct / xb) WHEN cb > 0 THEN ln(cb / xu) + CASE WHEN i > 2 THEN ln({ALPHA}) ELSE 0 END
      ELSE ln(greatest(cu, {UNSEEN}) / greatest(others, 1)) + (least(i, 3) - 1) * ln({ALPHA}) END AS v,
      coalesce(ct, 0) > 0 AS by3, coalesce(ct, 0) <= 0 AND coalesce(cb, 0) > 0 AS by2, cu = 0 AND coalesce(cb, 0) <= 0 AS unseen
      FROM s JOIN n USING (doc_id))
SELECT n.doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(CAST(count_if(by3) AS BIGINT), 0) AS n_trigram,
       coalesce(CAST(count_if(by2) AS BIGINT), 0) AS n_bigram, coalesce(CAST(count_if(unseen) AS BIGINT), 0) AS n_unseen,
       round(sum(v) / n_words, 6) AS score
FROM n LEFT JOIN l USING (doc_id) GROUP BY n.doc_id, n_words
"""


@register("op4_lm_scores", SQL)
def op4_lm_scores(spark, sf_dir):
    return (backoff_scores(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "n_words", F.element_at("by_order", 1).alias("n_trigram"),
                    F.element_at("by_order", 2).alias("n_bigram"), "n_unseen", F.round("score", 6).alias("score")))

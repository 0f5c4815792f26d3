"""op7: all documents mixed by source."""

from pyspark.sql import functions as F

from polarity.llm.common import WORD, table
from polarity.llm.mixing import mix, random_offset
from polarity.llm.registry import register

# The k sources with the least size per weight are capped; exactly one k gives a level between
# the k-th and the next source's bound.
SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS k,
      sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_size,
      coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_weight FROM o),
l AS (SELECT 3 * total - 4 * capped_size AS words, 2 * (weights - capped_weight) AS units FROM c
      WHERE 2 * source_size * 2 * (weights - capped_weight) >= (3 * total - 4 * capped_size) * weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN 2 * source_size * units < words * weight THEN CAST(2 * source_size AS DOUBLE)
      ELSE CAST(words AS DOUBLE) * weight / CAST(units AS DOUBLE) END AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS b,
      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(CAST('{random_offset()!r}' AS DOUBLE) + (b + 1) * e) - floor(CAST('{random_offset()!r}' AS DOUBLE) + b * e) AS BIGINT) * size AS taken FROM r
"""


@register("op7_mix_sources", SQL)
def op7_mix_sources(spark, sf_dir):
    return (mix(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"))

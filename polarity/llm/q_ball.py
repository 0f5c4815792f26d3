"""op11: codes of all embeddings, by codebooks trained on all of them."""

from pyspark.sql import functions as F

from polarity.llm.ball import ENTRIES, PARTS, ROUNDS, SCALE, label_errors, vector_codes
from polarity.llm.common import table
from polarity.llm.registry import register


def _sql() -> str:
    def nearest(book):
        return (f"SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, b.e, CAST(sum((x.val - b.val) * (x.val - b.val)) AS BIGINT) AS d "
                f"FROM x JOIN {book} b ON x.p = b.p AND x.i = b.i GROUP BY x.r, x.p, b.e) GROUP BY r, p")

    steps = []
    for k in range(ROUNDS):
        steps.append(f"code{k} AS MATERIALIZED ({nearest(f'book{k}')})")
        steps.append(f"sum{k} AS (SELECT c.p, c.e, x.i, CAST(sum(x.val) AS BIGINT) AS s, count(*) AS n FROM code{k} c JOIN x ON c.r = x.r AND c.p = x.p GROUP BY c.p, c.e, x.i)")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce((s - ((s % n) + n) % n) // n, b.val) AS val "
                     f"FROM book{k} b LEFT JOIN sum{k} t ON b.p = t.p AND b.e = t.e AND b.i = t.i)")
    return f"""
WITH sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)),
ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM sound),
kept AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (ORDER BY r) AS r FROM ranked WHERE len(v) = (SELECT len(v) FROM ranked WHERE r = 1)),
x AS MATERIALIZED (SELECT r, (k - 1) // (len(v) // {PARTS}) AS p, (k - 1) % (len(v) // {PARTS}) AS i, v[k] AS val FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, val FROM x WHERE r <= {ENTRIES}),
{', '.join(steps)},
last AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({nearest(f'book{ROUNDS}')}) GROUP BY r)
SELECT k.vec_id, l.code, l.error, CAST(sum(l.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept k JOIN last l ON k.r = l.r
"""


SQL = _sql()


def coded_embeddings(rows):
    codes, books = vector_codes(rows)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return (label_errors(codes.select("id", "label", hexed.alias("code"), "error"))
            .select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")))


@register("op11_vector_codes", SQL)
def op11_vector_codes(spark, sf_dir):
    return coded_embeddings(table(spark, sf_dir, "embeddings"))

"""op6: exact dedup of every document."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.exact import exact_groups
from polarity.llm.registry import register

SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@register("op6_exact_dedup", SQL)
def op6_exact_dedup(spark, sf_dir):
    return (exact_groups(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256")))

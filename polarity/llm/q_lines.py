"""op3: near-equal lines of all documents."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.lines import similar_lines
from polarity.llm.registry import register


@register("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    return (similar_lines(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "line", "class_id", "n_tokens", "n_copies", "n_links", "earlier_class", "removed"))

"""op9: every page's URL judged."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.registry import register
from polarity.llm.urls import judge


@register("op9_url_filter")
def op9_url_filter(spark, sf_dir):
    return (judge(table(spark, sf_dir, "pages"))
            .select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "by_model"))

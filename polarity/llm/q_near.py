"""op1: MinHash near-dedup of every document."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.near import near_components
from polarity.llm.registry import register


@register("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark, sf_dir):
    return (near_components(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept", "class_id"))

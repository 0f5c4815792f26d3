"""op10: all documents packed into sequences of 2048 tokens."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.packing import pack_documents
from polarity.llm.registry import register


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return (pack_documents(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))

"""op12: quality scores of all documents."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.ftrl import held_out, scored, train
from polarity.llm.registry import register

LEAST = 0.3


def quality_scores(docs, labels):
    model = train(docs, labels.filter(~held_out()))
    out = scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


@register("op12_quality_classifier")
def op12_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))

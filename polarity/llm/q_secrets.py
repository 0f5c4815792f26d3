"""op8: secrets in every document."""

from pyspark.sql import functions as F

from polarity.llm.common import table
from polarity.llm.registry import register
from polarity.llm.secrets import scan


def _told(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return (scan(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
                    count("hex").alias("n_hex"), F.sha2(_told(base), 256).alias("base_sha256"),
                    _told(F.col("spans")).alias("spans"), count("literal").alias("n_literal")))

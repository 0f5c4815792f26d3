"""op5: quality rules over every document."""

from polarity.llm.common import table
from polarity.llm.quality import quality_signals
from polarity.llm.registry import register


@register("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    return quality_signals(table(spark, sf_dir, "documents"))

"""polarity: learn and score the polarity of large text collections on Spark.

Layers:
  functions/  column expressions (cleaning, n-grams, number parsing, distances)
  sources/    table scans, file readers and writers
  operators/  relational and learning operators over DataFrames
  plans/      end-to-end batch jobs and the mapping of the test tables
  streaming/  Structured Streaming intake, count-triggered batching, scoring
  queries/    the registered queries and their DuckDB oracle SQL
"""

from polarity.config import Settings

__all__ = ["Settings"]

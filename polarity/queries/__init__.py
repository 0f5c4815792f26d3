"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle SQL per name."""

from polarity.queries.registry import ORACLE, QUERIES, load_all

__all__ = ["QUERIES", "ORACLE", "load_all"]

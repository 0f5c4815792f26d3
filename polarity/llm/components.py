"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.session import remove_path, table_path, write_table


def _star(near: DataFrame, name: str, tables: list) -> DataFrame:
    """(u, v, m): neighbours with u's smallest one, u included.  The minima are written out, so
    that the join reads them by an exchange of their own and a hub's rows can be split."""
    low = write_table(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
    tables.append(low)
    return near.join(low, "u")


def _edges(pairs: DataFrame, u: str, v: str) -> DataFrame:
    return (pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
            .filter("u != v").distinct())


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of ``pairs`` (columns u, v), component its smallest node.

    Alternates large-star (neighbours above a node move to its smallest neighbour) and small-star
    (neighbours below it do) until the edges no longer change; every round is a written table in
    the shared folder.  Null ends and loops are left out; an empty input has an empty result.
    """
    spark = pairs.sparkSession
    edges = write_table(_edges(pairs.dropna(subset=["u", "v"]), "u", "v"), "cc-edges")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        tables = [edges]
        both = edges.union(edges.select("v", "u"))
        large = write_table(_edges(_star(both, "cc-large-min", tables).filter("v > u"), "v", "m"), "cc-large")
        tables.append(large)
        small = _star(large, "cc-small-min", tables)
        edges = write_table(_edges(small, "v", "m").union(small.select("u", F.col("m").alias("v"))).distinct(),
                            "cc-edges")
        now = mark(edges)
        for t in tables:
            remove_path(spark, table_path(t))
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

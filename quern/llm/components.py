"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined to a table of their keys, where column ``n`` says how many rows a key has. Keys of more than a thousandth of ``total`` rows, a thousand at most, are broadcast, so that none crowds a task."""
    hot = per_key.where(F.col(n) * 1000 > total)
    if hot.isEmpty():
        return rows.join(per_key, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per_key.where(F.col(n) * 1000 <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for each node with an edge. ``edges``: columns u and v of one type that orders, no nulls.

    Alternating large and small stars: in each round every node's neighbours are linked to the
    smallest of them, until each component is a star. The number of rounds grows with the
    logarithm of the graph; no node's neighbours are gathered in one place. Each round is written
    to the shared folder, which cuts the lineage.
    """
    e = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = materialise(small, "stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = now

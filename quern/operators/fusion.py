"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def key(columns: list[str]) -> Column:
    """The id, or for hits without one their place."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("file_path", "start_line", "end_line", "chunk_type") if c in columns])
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), place) if "id" in columns else place


def ranked(hits: DataFrame) -> DataFrame:
    """A list of hits with rank from 1, by score, then id, then key. A result list: as long as its limit at most."""
    ties = [F.col("id")] if "id" in hits.columns else []
    return hits.withColumn("_key", key(hits.columns)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties, F.col("_key"))))


def ranked_whole(hits: DataFrame) -> DataFrame:
    """``ranked`` for lists without a limit: rows meet those of their own score alone, and the numbers of
    rows with higher scores are added. Scores are rounded, so that their table is short."""
    ties = [F.col("id")] if "id" in hits.columns else []
    per_score = hits.groupBy("score").count()
    before = per_score.select(F.col("score").alias("_s"), (F.sum("count").over(Window.orderBy(F.desc("score"))) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("score").orderBy(*ties, F.col("_key")))
    numbered = hits.withColumn("_key", key(hits.columns)).withColumn("_own", own)
    return numbered.join(before, F.col("score").eqNullSafe(F.col("_s"))).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_s", "_before")


def fuse(vector: DataFrame, keyword: DataFrame, alpha: float = 0.7, k: int = K, whole: bool = False) -> DataFrame:
    """The union of both lists by fused_score, rounded to 6 places: alpha/(k+rank) of the vector list
    and (1-alpha)/(k+rank) of the keyword list. A hit of both has the vector list's columns.
    vector_score and bm25_score are null for a list that hasn't the hit. ``whole``: the lists have no limit.
    """
    v, b = map(ranked_whole if whole else ranked, (vector, keyword))
    shared = [c for c in vector.columns if c in keyword.columns and c != "score"]
    v = v.select("_key", F.col("rank").alias("_vr"), F.round("score", 4).alias("vector_score"), *[F.col(c).alias(f"_v_{c}") for c in shared])
    b = b.select("_key", F.col("rank").alias("_br"), F.round("score", 4).alias("bm25_score"), *[F.col(c).alias(f"_b_{c}") for c in shared])
    both = v.join(b, "_key", "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    out = both.select(
        *[F.when(F.col("_vr").isNotNull(), F.col(f"_v_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in shared],
        F.round(part(alpha, "_vr") + part(1 - alpha, "_br"), 6).alias("fused_score"),
        "vector_score",
        "bm25_score",
        "_key",
    )
    return out.orderBy(F.desc("fused_score"), "_key").drop("_key")

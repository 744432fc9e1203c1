"""What has changed since a manifest was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(files: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """file_path and change: new, changed, unchanged or deleted, by the hashes of ``files`` and ``manifest`` (file_path, hash).

    ``full``: every file that is there counts as changed or new; those that are gone are deleted
    all the same. A null hash never equals another. Both sides join on the path, one shuffle each.
    """
    f = files.select("file_path", F.col("hash").alias("_now"), F.lit(True).alias("_here"))
    m = manifest.select("file_path", F.col("hash").alias("_then"), F.lit(True).alias("_was"))
    same = F.lit(False) if full else F.coalesce(F.col("_now") == F.col("_then"), F.lit(False))
    kind = F.when(F.col("_here").isNull(), "deleted").when(F.col("_was").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return f.join(m, "file_path", "full_outer").select("file_path", kind.alias("change"))


def next_manifest(manifest: DataFrame, indexed: DataFrame, gone: DataFrame) -> DataFrame:
    """``manifest`` without the paths in ``gone``, with the rows of ``indexed`` in place of its own."""
    drop = gone.select("file_path").unionByName(indexed.select("file_path"))
    return manifest.join(drop, "file_path", "left_anti").unionByName(indexed.select(*manifest.columns))

"""The files of a project: the first folders are listed on the driver, the others on the executors, where files are hashed and read."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Indexing
from quern.functions.text import OFFICE, chunk_id, language, sha256_id
from quern.sources.ignore import Rules, read_rules

#: Bytes read of all the files that one task gets; folders that the driver lists before the executors take over.
TASK_BYTES, FRONTIER = 64 << 20, 2000


def admits(path: str, size: int, rules: list[Rules], settings: Indexing) -> bool:
    """Whether a file is to be indexed, by its extension, the rules and its size; office files have a limit of their own."""
    ext = os.path.splitext(path)[1].lower()
    if ext not in _lowered(tuple(settings.file_extensions)) or any(r(path) for r in rules):
        return False
    return size <= 1024 * (settings.max_office_file_size_kb if ext[1:] in OFFICE else settings.max_file_size_kb)


@cache
def _lowered(extensions: tuple[str, ...]) -> frozenset[str]:
    return frozenset(x.lower() for x in extensions)


def walk(base: str, starts: list[str], rules: list[Rules], settings: Indexing, most: int | None = None) -> tuple[list[tuple[str, int]], list[str]]:
    """(path from ``base``, bytes) of what is to be indexed below the folders ``starts``, level by level; and the folders
    left when more than ``most`` of them wait."""
    out, todo = [], list(starts)
    while todo and (most is None or len(todo) <= most):
        below = []
        for at in todo:
            try:
                entries = sorted(os.scandir(os.path.join(base, at)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                path = at + e.name
                if e.is_dir(follow_symlinks=False):
                    if not any(r(path + "/") for r in rules):
                        below.append(path + "/")
                    continue
                try:
                    if not e.is_dir() and admits(path, size := e.stat().st_size, rules, settings):
                        out.append((path, size))
                except OSError:
                    continue
        todo = below
    return out, todo


def rules_of(base: str | Path, settings: Indexing) -> list[Rules]:
    """From the settings, from .indexignore, and from .gitignore if the settings respect it."""
    rules = [Rules(settings.exclude_patterns), read_rules(Path(base) / ".indexignore")]
    return [*rules, read_rules(Path(base) / ".gitignore")] if settings.respect_gitignore else rules


def list_files(project: str, settings: Indexing) -> list[tuple[str, int]]:
    """(path from the project, bytes) of what is to be indexed, in order of paths.

    Names with a leading dot or underscore are files like others. Links to folders aren't followed.
    """
    base = str(Path(project).resolve())
    return sorted(walk(base, [""], rules_of(base, settings), settings)[0])


def file_hash(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def listed(spark: SparkSession, project: str, settings: Indexing, frontier: int = FRONTIER) -> DataFrame:
    """file_path and file_size_bytes. Where more than ``frontier`` folders wait, the rest is walked by the executors."""
    base = str(Path(project).resolve())
    rules = rules_of(base, settings)
    found, folders = walk(base, [""], rules, settings, frontier)
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(len(found) or 1, cores), min(sum(n for _, n in found) // TASK_BYTES + 1, 10_000))
    out = spark.createDataFrame(sorted(found), "file_path string, file_size_bytes long").repartition(parts)
    if not folders:
        return out

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame["folder"]:
                yield pd.DataFrame(walk(base, [at], rules, settings)[0], columns=["file_path", "file_size_bytes"])

    below = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(min(len(folders), 8 * cores))
    # A task's folders may hold anything: their files are dealt out again.
    return out.unionByName(below.mapInPandas(rest, "file_path string, file_size_bytes long").repartition(max(cores, len(folders))))


def _contents(base: str, content: bool):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                out = frame.iloc[at : at + 64].copy()
                data = []
                for path in out["file_path"]:
                    try:
                        data.append(Path(base, path).read_bytes())
                    except OSError:
                        data.append(None)
                out["hash"] = [None if d is None else file_hash(d) for d in data]
                if content:
                    out["file_size_bytes"] = [0 if d is None else len(d) for d in data]
                    out["content"] = data
                yield out

    return read


def scan(spark: SparkSession, project: str, settings: Indexing) -> DataFrame:
    """file_path, file_size_bytes, hash and language. A file that is gone by the time it is read has no hash (null).

    The folder must be one that all executors see.
    """
    base = str(Path(project).resolve())
    hashed = listed(spark, project, settings).mapInPandas(_contents(base, False), "file_path string, file_size_bytes long, hash string")
    return hashed.withColumn("language", language(F.col("file_path")))


def read_files(spark: SparkSession, project: str, paths: DataFrame, per_task: int | None = None) -> DataFrame:
    """file_path, hash, file_size_bytes and content of the paths given (file_path), as they are now: the hash is that of the content."""
    base = str(Path(project).resolve())
    some = paths.select("file_path", F.lit(0).cast("long").alias("file_size_bytes"))
    if per_task:
        some = some.repartition(max(1, min(10_000, -(-some.count() // per_task))))
    return some.mapInPandas(_contents(base, True), "file_path string, file_size_bytes long, hash string, content binary")


__all__ = ["chunk_id", "file_hash", "list_files", "listed", "read_files", "scan", "sha256_id"]

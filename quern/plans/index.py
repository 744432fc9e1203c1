"""Building and updating an index."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.chunkers.dispatch import chunk_rows, chunks_of, errors_of
from quern.config import Config
from quern.functions.embed import embed_chunks
from quern.operators import bm25
from quern.operators.changes import changes
from quern.session import Scratch, release
from quern.sources.scan import read_files, scan
from quern.store import Store


def build(spark: SparkSession, store: Store, files: DataFrame, config: Config, full: bool = False, contents: Callable[[DataFrame], DataFrame] | None = None, partial: bool = False) -> dict:
    """Bring ``store`` up to date with ``files`` (file_path, hash, file_size_bytes, and content unless ``contents`` reads it).

    Only files whose hash is new are read, chunked and embedded; the manifest holds the hash of the bytes
    that were chunked. ``contents`` gives for paths (file_path) the same columns and the content. An update writes what is new
    and the names of what is gone; ``full`` starts
    afresh: nothing of an older index but its cache of vectors is kept. ``partial``: files that aren't among ``files`` stay.
    All tables change together, when the new generation is complete.
    """
    with Scratch(spark) as scratch:
        return _build(scratch, store, files, config, full, contents, partial)


def _build(scratch: Scratch, store: Store, files: DataFrame, config: Config, full: bool, contents, partial: bool) -> dict:
    began, table = time.time(), scratch.table
    here = files.where("hash is not null")
    if contents is None:
        here = table(here, "files")
    manifest = store.read("manifest")
    if partial:
        manifest = manifest.join(here.select("file_path"), "file_path", "left_semi")
    diff = table(changes(here, manifest, full), "diff")
    counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
    complete = store.known("chunks") and store.known("postings") and store.known("docs")
    if not full and complete and not counts.get("new", 0) + counts.get("changed", 0) + counts.get("deleted", 0):
        return {"status": "up_to_date", "files_indexed": 0, "files_deleted": 0, "files_unchanged": counts.get("unchanged", 0), "chunks_created": 0, "duration_seconds": round(time.time() - began, 2)}
    todo = diff.where("change in ('new', 'changed')").select("file_path")
    picked = here.join(todo, "file_path", "left_semi") if contents is None else table(contents(todo), "contents").where("hash is not null")
    # Chunks and errors come from one pass.
    both = table(chunk_rows(picked, config.chunking), "chunks")
    made, errors = chunks_of(both), errors_of(both)
    # Texts lie on the disk once at a time, besides what is on its way.
    read = table(picked.select("file_path", "hash", "file_size_bytes"), "read")
    scratch.drop("files", "contents")
    release(store.spark)
    cache = store.read("cache")
    keyed, new = embed_chunks(made, cache, config.embedding)
    new = table(new, "vectors")
    own = cache.where((F.col("model") == config.embedding.model) & (F.col("dimensions") == config.embedding.dimensions))
    release(store.spark)
    vectors = own.unionByName(new).select("content_hash", "vector")
    fresh = store.check_vectors(keyed.join(vectors, "content_hash", "left").drop("content_hash"))
    per_file = made.groupBy("file_path").agg(F.count("*").cast("int").alias("chunk_count"))
    rows = read.join(per_file, "file_path", "left").select("file_path", "hash", F.current_timestamp().alias("last_indexed"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "file_size_bytes")
    # A file that failed is tried again next time.
    rows = rows.join(errors.select("file_path"), "file_path", "left_anti")
    if full:
        tables = {"chunks": fresh, "manifest": rows, "cache": own.unionByName(new)} | store.keyword_tables(made.select("id", "content"), table)
        store.write(tables)
    else:
        left = diff.where("change != 'unchanged'").select("file_path")
        old = store.read("chunks").select("id", "file_path")
        ids = table(old.join(left, "file_path", "left_semi").select(F.col("id").alias("key")), "gone")
        more, tables = {"chunks": fresh, "manifest": rows, "cache": new}, {}
        part = store.keyword_tables(made.select("id", "content"), table)
        if store.known("postings") and store.known("docs"):
            more |= {n: part[n] for n in ("postings", "docs")}
            docs = store.read("docs").join(ids.withColumnRenamed("key", "id"), "id", "left_anti").unionByName(part["docs"])
            tables["stats"] = bm25.corpus_stats(docs)
        else:
            # Chunks without a keyword index: it is made from all of them.
            kept = store.read("chunks").join(left, "file_path", "left_anti")
            tables |= store.keyword_tables(kept.select("id", "content").unionByName(made.select("id", "content")), table)
        store.write(tables, more, {"id": ids, "file_path": left.withColumnRenamed("file_path", "key")})
        store.compact()
    return {
        "status": "success",
        "files_indexed": counts.get("new", 0) + counts.get("changed", 0),
        "files_deleted": counts.get("deleted", 0),
        "files_unchanged": counts.get("unchanged", 0),
        "files_failed": errors.count(),
        "chunks_created": made.count(),
        "chunks_embedded": new.count(),
        "duration_seconds": round(time.time() - began, 2),
    }


def build_project(spark: SparkSession, project: str, store: Store, config: Config, full: bool = False, batch_size: int | None = None) -> dict:
    """Scan a folder and build. Every file is hashed where it lies; those to be indexed are read once more, and what was read
    then is hashed and chunked. ``batch_size``: files that one task takes at most."""
    files = scan(spark, project, config.indexing)
    return build(spark, store, files, config, full, lambda paths: read_files(spark, project, paths, batch_size))


def bootstrap_keywords(store: Store) -> bool:
    """Make the keyword tables of an index that has chunks alone."""
    if store.known("postings") or not store.has("chunks"):
        return False
    store.write(store.keyword_tables(store.read("chunks").select("id", "content")))
    return True


def status(store: Store, files: DataFrame, config: Config) -> dict:
    """What the index holds, and how many files it is behind: stale ones would be indexed, deleted ones removed."""
    manifest, chunks = store.read("manifest"), store.read("chunks")
    diff = {r["change"]: r["n"] for r in changes(files.where("hash is not null"), manifest).groupBy("change").agg(F.count("*").alias("n")).collect()}
    top = manifest.agg(F.count("*").alias("n"), F.max("last_indexed").alias("at")).first()
    return {
        "indexed": store.has("chunks"),
        "total_files": top["n"],
        "total_chunks": chunks.count(),
        "last_indexed": top["at"].isoformat() if top["at"] else None,
        "stale_files": diff.get("new", 0) + diff.get("changed", 0),
        "deleted_files": diff.get("deleted", 0),
        "embedding_model": config.embedding.model,
        "dimensions": config.embedding.dimensions,
        "index_size_mb": round(store.size_bytes() / 1048576, 2),
        "languages": {r["language"]: r["n"] for r in chunks.where("language != ''").groupBy("language").agg(F.count("*").alias("n")).collect()},
    }

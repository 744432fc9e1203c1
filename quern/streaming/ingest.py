"""Documents that keep arriving, indexed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.config import Config
from quern.functions.text import sha256_id
from quern.operators import bm25
from quern.plans.index import build
from quern.store import Store


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n) over all that has arrived, for a sink in complete or update mode. Tokenising is stateless; the counts are the state."""
    return bm25.tokens(documents, id_col, text_col).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def index_stream(spark: SparkSession, documents: DataFrame, store: Store, config: Config, checkpoint: str) -> StreamingQuery:
    """Index every batch of ``documents`` (file_path, content string) until there is no more.

    A path that comes again replaces its older rows; nothing is deleted. A batch that is run again
    after a failure meets its own hashes in the manifest and changes nothing.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["file_path"]).select("file_path", F.col("content").cast("binary").alias("content"), sha256_id(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("file_size_bytes"))
        build(spark, store, rows, config, partial=True)  # paths that aren't in the batch stay as they are

    return documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

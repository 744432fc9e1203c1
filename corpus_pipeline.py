"""From documents to packed sequences, in five stages that each call one operator.

A stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents, and any others that come with them, whatever their names.

In every stage a null text counts as empty, a very long text is taken whole, an empty table gives an empty
result, and a null id or source is a value of its own; what else a stage does with nulls, ties and
repeated rows is said at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import op01_mixing, op02_packing, op05_quality_classifier, op08_simhash, op10_line_dedup
from quern.llm.entries import tokenizer_path
from quern.session import materialise, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more; the rest go. A text without words has the bias for its score. Repeated rows stay or go
    together. Without labels of both kinds every score is 0.5 and all stay."""
    ship(spark)
    weights = op05_quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op05_quality_classifier.score(docs, weights, threshold=0.3, keep=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line matches; n_chars follows the text. No row goes, if its text becomes
    empty; a null text stays null. Earlier: the smaller id (null last), of equal ids the smaller hash of the text. Rows of equal id and
    text are one document: both lose the same lines, and neither loses lines for the other."""
    ship(spark)
    out = op10_line_dedup.remove_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id (null last), of equal ids that with the smallest
    hash of the text, of equal rows one. Texts without words are one group."""
    ship(spark)
    return op08_simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document may come up to three times. Texts without words weigh nothing and are
    never taken. Rows of equal id, text and source are taken together."""
    ship(spark)
    return op01_mixing.take_copies(docs, weights=(5, 2, 1), cap=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 ids. A text without ids is its end mark alone;
    repeated rows are packed each by itself; pieces of one length are alike, so that ties don't matter."""
    ship(spark)
    return op02_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

#: Hashing, training and packing aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs

"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op02_packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query()
def op4_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op04_store import read_checksums, write_store
    from quern.session import new_path

    path = new_path(spark, "store")
    write_store(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_checksums(spark, path)


@query()
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op01_mixing import mix_by_rank

    return mix_by_rank(documents(spark, sf_dir), weights=(5, 2, 1), cap=3)


@query()
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op03_quality_rules import judge

    return judge(documents(spark, sf_dir))


@query()
def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op05_quality_classifier import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


@query()
def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op07_multiset_hash import with_neighbours

    return with_neighbours(documents(spark, sf_dir))


@query()
def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op08_simhash import groups

    return groups(documents(spark, sf_dir))


@query()
def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op09_hmm import score

    return score(documents(spark, sf_dir))


@query()
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op10_line_dedup import report

    return report(documents(spark, sf_dir))


@query()
def op6_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.op06_token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))

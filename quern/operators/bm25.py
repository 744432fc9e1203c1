"""Keyword retrieval by Okapi BM25 over tables of postings.

    docs      id, dl (terms of the document)
    postings  term, id, tf, and in an index also dl
    stats     n_docs, total_len: one row of sums, which add up over parts of a corpus

A document without terms is in ``docs`` with dl 0 and counts towards the mean length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS, is_term, pieces, terms, terms_of
from quern.session import materialise

K1, B = 1.5, 0.75
#: Bytes of text that a worker counts at once.
SLICE = 2 << 20
_POSTS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))


def tokens(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, term) for each word; a null term for what isn't one, so that every document has a row.

    The text is split and exploded at once, so that words are tested in generated code.
    """
    raw = chunks.select(F.col(id_col).alias("id"), F.explode(pieces(F.col(text_col))).alias("_w")).withColumn("_w", F.lower("_w"))
    return raw.select("id", F.when(is_term(F.col("_w")), F.col("_w")).alias("term"))


def postings(toks: DataFrame) -> DataFrame:
    return toks.where("term is not null").groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))


def _counted(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(lengths, postings) of texts, as ``terms`` has their words."""
    split = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern="([a-z])([A-Z])", replacement=r"\1 \2")
    split = pc.split_pattern_regex(split, pattern="[^A-Za-z0-9]+")
    words, of = pc.ascii_lower(split.flatten()), pc.list_parent_indices(split)
    use = pc.and_(pc.greater_equal(pc.binary_length(words), 2), pc.invert(pc.is_in(words, value_set=pa.array(STOP_WORDS))))
    coded, of = words.filter(use).dictionary_encode(), of.filter(use).to_numpy(zero_copy_only=False)
    n = max(1, len(coded.dictionary))
    pairs, tf = np.unique(of.astype(np.int64) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    posts = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % n)), pa.array(tf, pa.int32())], ["term", "tf"])
    ends = np.searchsorted(pairs, np.arange(len(texts) + 1, dtype=np.int64) * n)
    return pa.array(np.bincount(of, minlength=len(texts)), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), posts).cast(_POSTS)


def slices(text: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of about ``most`` bytes of text, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop - at
        at = stop


def counted(chunks: DataFrame, id_col: str = "id", text_col: str = "content", unique: bool = False) -> DataFrame:
    """A row a document: id, dl, posts (array of term, tf); one without terms has no posts.

    A text is counted where it lies, so that no term crosses the network before a plan needs it elsewhere, and what
    replaces or removes documents moves rows of documents. Rows that share an id are one document; unless ids are known to be
    ``unique``, they are looked through first.
    """
    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    if not unique and not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.array_join(F.collect_list("_text"), "\n").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1), SLICE):
                dl, posts = _counted(batch.column(1).slice(at, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), dl, posts], ["id", "dl", "posts"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dl int, posts array<struct<term: string, tf: int>>")


def unfold(docs: DataFrame, *more: str) -> DataFrame:
    """The postings of ``counted`` documents: term, id, tf, and other columns of theirs."""
    return docs.select("id", *more, F.inline("posts")).select("term", "id", "tf", *more)


def doc_lengths(toks: DataFrame) -> DataFrame:
    return toks.groupBy("id").agg(F.count("term").cast("int").alias("dl"))


def lengths(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The same straight from the texts, without a shuffle; ids must differ."""
    return chunks.select(F.col(id_col).alias("id"), F.size(terms(F.col(text_col))).alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def score(query: str, post: DataFrame, docs: DataFrame | None, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(id, raw): the score of every document that holds a term of ``query``.

    A term counts as often as the query has it. Frequencies are of the whole corpus. Only the
    query's postings are read, through a literal filter that reaches the files; their counts are a
    few rows, one a term. Where postings have their documents' lengths, ``docs`` isn't read. An empty query, and a corpus without terms, give nothing.
    """
    spark = post.sparkSession
    wanted = Counter(terms_of(query))
    if not wanted:
        return spark.createDataFrame([], "id string, raw double").select(F.col("id").cast(post.schema["id"].dataType).alias("id"), "raw")
    hits = post.where(F.col("term").isin(*wanted))
    weight = F.create_map(*[F.lit(x) for t, n in wanted.items() for x in (t, float(n))])
    df = F.broadcast(document_frequency(hits))  # at most the query's terms
    one = F.broadcast(stats)  # one row
    n, avg = F.col("n_docs"), F.col("total_len") / F.col("n_docs")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = weight[F.col("term")] * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    long = hits if "dl" in hits.columns else hits.join(docs.select("id", "dl"), "id")
    rows = long.join(df, "term").join(one).where("total_len > 0")
    return rows.groupBy("id").agg(F.sum(part).alias("raw"))


def scan_score(query: str, chunks: DataFrame, id_col: str = "id", text_col: str = "content", k1: float = K1, b: float = B) -> DataFrame:
    """``score`` straight from the texts, without postings: (id, raw).

    One pass makes each document's length and its counts of the query's terms; no term crosses the
    network. The counts of documents are sums over that narrow table, which is written between.
    """
    wanted = Counter(terms_of(query))
    narrow = chunks.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_t"))
    met = narrow.select("id", F.size("_t").alias("dl"), F.filter("_t", lambda t: t.isin(*wanted) if wanted else F.lit(False)).alias("_t"))
    # What a term's removal takes from the few that were met is its count.
    tf = [(F.size("_t") - F.size(F.array_remove("_t", t))).alias(f"_tf{i}") for i, t in enumerate(wanted)]
    rows = materialise(met.select("id", "dl", *tf), "counts")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("len"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))]).first()
    if not wanted or not sums["len"]:
        return rows.where("false").select("id", F.lit(0.0).alias("raw"))
    n, avg, total = sums["n"], sums["len"] / sums["n"], F.lit(0.0)
    for i, times in enumerate(wanted.values()):
        idf = math.log((n - sums[f"_df{i}"] + 0.5) / (sums[f"_df{i}"] + 0.5) + 1)
        f = F.col(f"_tf{i}")
        total = total + F.lit(times * idf * (k1 + 1)) * f / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avg)))
    return rows.where(" or ".join(f"_tf{i} > 0" for i in range(len(wanted)))).select("id", total.alias("raw"))


def search(query: str, post: DataFrame, docs: DataFrame | None, stats: DataFrame, top_k: int, where: Column | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """The ``top_k`` best of ``chunks`` (by default of ``docs``) for which ``where`` holds: id, the columns of ``chunks``, score rounded to 4 places.

    Filters come after scoring and before the cut, so that they change no score. Equal scores go by id.
    """
    found = score(query, post, docs, stats).withColumn("score", F.round("raw", 4))
    rows = found.join(chunks, "id") if chunks is not None else found
    if where is not None:
        rows = rows.where(where)
    return rows.drop("raw").orderBy(F.desc("score"), "id").limit(top_k)


def delete_by_file(table: DataFrame, chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """``table`` (with an id) without the documents of the given paths."""
    gone = chunks.join(paths.select("file_path"), "file_path", "left_semi").select("id")
    return table.join(gone, "id", "left_anti")


def add(table: DataFrame, fresh: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """Rows of ids that come again replace the older ones. Postings don't name a document that has no terms now, so that
    for them ``again`` must have the ids of all documents of ``fresh``; ``counted`` documents have a row each."""
    return table.join((fresh if again is None else again).select("id").distinct(), "id", "left_anti").unionByName(fresh)


def reference_score(query: str, texts: list[str], k1: float = K1, b: float = B) -> list[float]:
    """The formula on the driver, for small sets."""
    sets = [Counter(terms_of(t)) for t in texts]
    n, avg = len(sets), sum(sum(s.values()) for s in sets) / max(1, len(sets))
    out = []
    for s in sets:
        total = 0.0
        for t in terms_of(query):
            df = sum(1 for x in sets if t in x)
            if avg > 0 and t in s:
                total += math.log((n - df + 0.5) / (df + 0.5) + 1) * s[t] * (k1 + 1) / (s[t] + k1 * (1 - b + b * sum(s.values()) / avg))
        out.append(total)
    return out

"""Queries over the given tables, one for each operator, and the same in SQL.

Documents stand for chunks: the id is doc_id, the language lang, and the path source/doc_id.txt.
Embeddings go with documents by equal number; that pairing is made up, as the tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import config as settings
from quern import schema
from quern.chunkers.dispatch import chunk_files
from quern.config import Chunking
from quern.functions import embed
from quern.functions import text as tx
from quern.operators import bm25, changes, fusion, rerank, vector
from quern.plans import index
from quern.plans.search import Query, combine, search
from quern.session import new_path, spread
from quern.sources.ignore import Rules
from quern.sources.scan import admits
from quern.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = "que der los thtion reanti ververung of the"
TWICE = "que que der thtion"
GLOB = "src1*/**"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _path() -> F.Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), _path().alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def _vector0(spark: SparkSession, sf: str) -> list[float]:
    return list(_embeddings(spark, sf).where("vec_id = 0").first()["embedding"])


#: Indexes of the tables, written once in a session: (application, folder) -> path.
_built: dict[tuple[str, str], str] = {}


def _store(spark: SparkSession, sf: str) -> Store:
    """The documents as a stored index, a chunk each; those without an embedding have a vector of zeros, which no search finds. The manifest is ``_manifest``'s."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        store = Store(spark, new_path(spark, "catalog"))
        width = len(_vector0(spark, sf))
        vectors = _embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
        rows = _chunks(spark, sf).withColumn("id", F.col("id").cast("string"))
        rows = rows.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "chunk_type": F.lit("unknown"), "symbol_name": F.lit(""), "token_count": F.lit(0), "metadata": F.lit(None)})
        chunks = rows.join(vectors, "id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), width)))
        manifest = _manifest(spark, sf).withColumns({"last_indexed": F.timestamp_seconds(F.lit(0)), "chunk_count": F.lit(1), "file_size_bytes": F.lit(0)})
        store.write({"chunks": chunks.select(*schema.STORED.fieldNames()), "manifest": manifest} | store.keyword_tables(rows.select("id", "content")))
        _built[key] = store.path
    return Store(spark, _built[key])


class _First(embed.Provider):
    """Whatever the query: the first vector of the table."""

    vector: list[float] = []

    def embed(self, texts):
        return [self.vector for _ in texts]


def _found(spark: SparkSession, sf: str, **options) -> DataFrame:
    """A search of the stored index for ``WORDS``."""
    first = _vector0(spark, sf)
    provider = type("First", (_First,), {"vector": first})
    embed.register("first", provider)
    config = settings.Config(embedding=settings.Embedding(provider="first", dimensions=len(first)))
    return search(_store(spark, sf), Query(WORDS, **options), config)


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = f"""tok AS (SELECT doc_id, lower(w) AS term FROM (
  SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+')) AS w FROM documents)
  WHERE length(w) >= 2 AND lower(w) NOT IN ({_STOP})),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
stat AS (SELECT count(*) AS n, sum(dl) AS total FROM dl)"""


def _bm25_sql(words: str, where: str = "true") -> str:
    """CTEs ending in bm(id, score): every document that holds a term and for which ``where`` (over d) holds."""
    values = ", ".join(f"('{w}')" for w in tx.terms_of(words))
    return f"""WITH {_TOKENS},
q AS (SELECT term, count(*) AS times FROM (VALUES {values}) v(term) GROUP BY term),
tf AS (SELECT t.doc_id, t.term, count(*) AS tf FROM tok t JOIN q ON t.term = q.term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT tf.doc_id, sum(q.times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / (total / n)))) AS s
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN stat GROUP BY tf.doc_id),
bm AS (SELECT r.doc_id AS id, round(s, 4) AS score, d.lang AS language, concat(d.source, '/', d.doc_id, '.txt') AS file_path, d.text AS content
  FROM raw r JOIN documents d ON d.doc_id = r.doc_id WHERE {where})"""


_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_VEC = f"vec AS (SELECT e.vec_id AS id, e.label, round({_COSINE}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _bm25(spark: SparkSession, sf: str, words: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    return bm25.scan_score(words, chunks).withColumn("score", F.round("raw", 4)).join(chunks.drop("content"), "id")


# Keyword index


@query(f"WITH {_TOKENS} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")
def bm25_tokenize(spark, sf):
    return bm25.unfold(bm25.counted(_docs(spark, sf), "doc_id", "text")).select(F.col("id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {_TOKENS} SELECT doc_id, dl FROM dl")
def bm25_doc_lengths(spark, sf):
    return bm25.lengths(_docs(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("dl").cast("long").alias("dl"))


@query(f"WITH {_TOKENS} SELECT n AS n_docs, total::BIGINT AS total_len FROM stat")
def bm25_corpus_stats(spark, sf):
    return bm25.corpus_stats(bm25.lengths(_docs(spark, sf), "doc_id", "text"))


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term")
def bm25_term_df(spark, sf):
    return bm25.document_frequency(bm25.unfold(bm25.counted(_docs(spark, sf), "doc_id", "text")))


@query(_bm25_sql(WORDS) + " SELECT id, score FROM bm")
def bm25_scores(spark, sf):
    return _bm25(spark, sf, WORDS).select("id", "score")


@query(_bm25_sql(WORDS) + " SELECT id, file_path, language, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_search_topk(spark, sf):
    return _bm25(spark, sf, WORDS).select("id", "file_path", "language", "score").orderBy(F.desc("score"), "id").limit(10)


@query(_bm25_sql(WORDS) + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_search_postings(spark, sf):
    """From the stored postings: the folders of the query's terms alone are opened."""
    store = _store(spark, sf)
    found = bm25.search(WORDS, store.query_postings(tx.terms_of(WORDS)).withColumn("id", F.col("id").cast("long")), None, store.read("stats"), 10)
    return found.select("id", "score")


_TEXT_ID = "CAST(id AS VARCHAR) AS id"


@query(_bm25_sql(WORDS, "regexp_matches(concat(d.source, '/', d.doc_id, '.txt'), '^src1[^/]*/.+$') AND d.lang = 'en'") + f"""
SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score, file_path, language FROM (
  SELECT * FROM (SELECT {_TEXT_ID}, score, file_path, language FROM bm ORDER BY score DESC, id LIMIT 40) WHERE score >= 2 ORDER BY score DESC, id LIMIT 20)""")  # fmt: skip
def search_keyword(spark, sf):
    """The whole search of the stored index: filters, over-fetch, threshold, cut and ranks."""
    return _found(spark, sf, mode="keyword", top_k=20, threshold=2.0, language="en", path=GLOB).select("rank", "id", "score", "file_path", "language")


@query(_bm25_sql(TWICE) + " SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20")
def bm25_duplicate_terms(spark, sf):
    return _bm25(spark, sf, TWICE).select("id", "score").orderBy(F.desc("score"), "id").limit(20)


@query(_bm25_sql(WORDS, "d.lang = 'de'") + " SELECT id, language, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_filter_lang(spark, sf):
    return _bm25(spark, sf, WORDS).where("language = 'de'").select("id", "language", "score").orderBy(F.desc("score"), "id").limit(10)


@query(_bm25_sql(WORDS, "regexp_matches(concat(d.source, '/', d.doc_id, '.txt'), '^src1[^/]*/.+$')") + " SELECT id, file_path, score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25_filter_glob(spark, sf):
    return _bm25(spark, sf, WORDS).where(tx.matches_glob(F.col("file_path"), GLOB)).select("id", "file_path", "score").orderBy(F.desc("score"), "id").limit(10)


@query(_bm25_sql(WORDS) + " SELECT id, score FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 40) WHERE score >= 2.5 ORDER BY score DESC, id LIMIT 20")
def keyword_threshold(spark, sf):
    hits = _bm25(spark, sf, WORDS).select("id", "score").orderBy(F.desc("score"), "id").limit(40)
    return hits.where("score >= 2.5").orderBy(F.desc("score"), "id").limit(20)


# Vectors


@query(f"WITH {_VEC} SELECT id, label, score FROM vec ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, sf):
    return vector.search(_embeddings(spark, sf).withColumnRenamed("vec_id", "id"), _vector0(spark, sf), 10, vector_col="embedding").select("id", "label", "score")


@query(f"WITH {_VEC} SELECT id, score FROM (SELECT * FROM vec ORDER BY score DESC, id LIMIT 20) WHERE score >= 0.3")
def vector_threshold(spark, sf):
    hits = vector.search(_embeddings(spark, sf).withColumnRenamed("vec_id", "id"), _vector0(spark, sf), 20, vector_col="embedding")
    return hits.where("score >= 0.3").select("id", "score")


@query(f"WITH {_VEC} SELECT id, label, score FROM vec WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, id LIMIT 10")
def vector_filter_label(spark, sf):
    e = _embeddings(spark, sf).withColumnRenamed("vec_id", "id")
    label = e.where("id = 0").first()["label"]
    return vector.search(e, _vector0(spark, sf), 10, F.col("label") == label, "embedding").select("id", "label", "score")


@query(f"WITH {_VEC} SELECT id, score FROM vec")
def vector_scores(spark, sf):
    e = _embeddings(spark, sf)
    return e.select(F.col("vec_id").alias("id"), F.round(vector.cosine(F.col("embedding"), _vector0(spark, sf)), 4).alias("score"))


_VEC_DOCS = """vd AS (SELECT CAST(v.id AS VARCHAR) AS id, v.score, d.lang AS language, concat(d.source, '/', d.doc_id, '.txt') AS file_path, d.text AS content
  FROM vec v JOIN documents d ON d.doc_id = v.id WHERE v.score IS NOT NULL)"""


@query(f"""WITH {_VEC}, {_VEC_DOCS}
SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score, file_path, language FROM (
  SELECT * FROM (SELECT * FROM vd WHERE language = 'de' ORDER BY score DESC, id LIMIT 40) WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 20)""")  # fmt: skip
def search_vector(spark, sf):
    return _found(spark, sf, mode="vector", top_k=20, threshold=0.1, language="de").select("rank", "id", "score", "file_path", "language")


# Fusion


def _lists(spark, sf, n=20):
    v = vector.search(_embeddings(spark, sf).withColumnRenamed("vec_id", "id"), _vector0(spark, sf), n, vector_col="embedding").select("id", "score")
    return v, _bm25(spark, sf, WORDS).select("id", "score").orderBy(F.desc("score"), "id").limit(n)


def _rrf_sql(alpha: float, limit: str = "", n: int | None = 20, keyword: str | None = None) -> str:
    own = keyword or f"(SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {n})"
    return (
        _bm25_sql(WORDS)
        + f""", {_VEC},
v AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM vec{f" ORDER BY score DESC, id LIMIT {n}" if n else " WHERE score IS NOT NULL"})),
b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {own})
SELECT coalesce(v.id, b.id) AS id, round(coalesce({alpha}::DOUBLE / (60 + v.r), 0) + coalesce((1 - {alpha})::DOUBLE / (60 + b.r), 0), 6) AS fused_score,
  v.score AS vector_score, b.score AS bm25_score FROM v FULL OUTER JOIN b ON v.id = b.id {limit}"""
    )


def _fused(alpha):
    def run(spark, sf):
        v, b = _lists(spark, sf)
        return fusion.fuse(v, b, alpha).select("id", "fused_score", "vector_score", "bm25_score")

    return run


for _name, _alpha in (("rrf_hybrid_full", 0.7), ("rrf_alpha_0", 0.0), ("rrf_alpha_05", 0.5), ("rrf_alpha_1", 1.0)):
    QUERIES[_name], SQL[_name] = _fused(_alpha), _rrf_sql(_alpha)


@query(_rrf_sql(0.7, keyword="(SELECT id, 10 - score AS score FROM vec WHERE score IS NOT NULL)", n=None))
def rrf_overlap(spark, sf):
    """Both lists hold each vector, in opposite orders, so that every score is a sum."""
    e = _embeddings(spark, sf).withColumnRenamed("vec_id", "id")
    v = vector.search(e, _vector0(spark, sf), None, vector_col="embedding").select("id", "score")
    b = v.select("id", (10 - F.col("score")).alias("score"))
    return fusion.fuse(v, b, 0.7, whole=True).select("id", "fused_score", "vector_score", "bm25_score")


@query(f"WITH {_VEC} SELECT id, score FROM vec ORDER BY score DESC, id LIMIT 20")
def rrf_fallback_one_side(spark, sf):
    """Without keyword hits a hybrid search gives the vector list as it is."""
    v, b = _lists(spark, sf)
    merged, _ = combine(v, b.where("false"), "hybrid", 0.7)
    return merged.select("id", "score")


@query(_bm25_sql(WORDS) + f""", top AS (SELECT id, score, content FROM bm ORDER BY score DESC, id LIMIT 20),
words AS (SELECT DISTINCT top.id, t.term FROM top JOIN tok t ON t.doc_id = top.id WHERE t.term IN (SELECT term FROM q))
SELECT id, rerank_score FROM (SELECT top.id, top.score, round((SELECT count(*) FROM words w WHERE w.id = top.id) / (SELECT count(*) FROM q)::DOUBLE, 4) AS rerank_score FROM top)
ORDER BY rerank_score DESC, score DESC, id LIMIT 10""")  # fmt: skip
def rerank_overlap(spark, sf):
    chunks = _chunks(spark, sf)
    top = bm25.scan_score(WORDS, chunks).withColumn("score", F.round("raw", 4)).join(chunks, "id").orderBy(F.desc("score"), "id").limit(20)
    best = rerank.rerank(top.withColumn("_place", -F.col("score")), WORDS, 20, order=F.col("_place"))
    return best.orderBy(F.desc("rerank_score"), F.desc("score"), "id").limit(10).select("id", "rerank_score")


_HYBRID = (
    _bm25_sql(WORDS, "d.lang = 'en'")
    + f""", {_VEC}, {_VEC_DOCS},
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM vd WHERE language = 'en' ORDER BY score DESC, id LIMIT 40)),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT CAST(id AS VARCHAR) AS id, score, language, file_path, content FROM bm ORDER BY score DESC, id LIMIT 40)),
f AS (SELECT coalesce(v.id, b.id) AS id, round(coalesce(0.5::DOUBLE / (60 + v.r), 0) + coalesce(0.5::DOUBLE / (60 + b.r), 0), 6) AS score,
  v.score AS vector_score, b.score AS bm25_score, coalesce(v.content, b.content) AS content FROM v FULL OUTER JOIN b ON v.id = b.id),
best AS (SELECT * FROM f ORDER BY score DESC, id LIMIT 20)"""
)


@query(_HYBRID + " SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score, vector_score, bm25_score FROM best")
def search_hybrid(spark, sf):
    return _found(spark, sf, mode="hybrid", top_k=20, alpha=0.5, language="en").select("rank", "id", "score", "vector_score", "bm25_score")


@query(_HYBRID + """, words AS (SELECT DISTINCT best.id, t.term FROM best JOIN tok t ON CAST(t.doc_id AS VARCHAR) = best.id WHERE t.term IN (SELECT term FROM q)),
again AS (SELECT id, score, round((SELECT count(*) FROM words w WHERE w.id = best.id) / (SELECT count(*) FROM q)::DOUBLE, 4) AS rerank_score FROM best)
SELECT row_number() OVER (ORDER BY rerank_score DESC, score DESC, id) AS rank, id, rerank_score AS score FROM (SELECT * FROM again ORDER BY rerank_score DESC, score DESC, id LIMIT 10)""")  # fmt: skip
def search_hybrid_reranked(spark, sf):
    return _found(spark, sf, mode="hybrid", top_k=20, alpha=0.5, language="en", rerank=True).select("rank", "id", "score")


# Ids, cache, change detection, files


@query("SELECT doc_id, concat('sha256:', sha256(concat(source, '/', doc_id, '.txt:1:', text))) AS id FROM documents")
def chunk_ids(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.chunk_id(_path(), F.lit(1), F.col("text")).alias("id"))


@query("SELECT lang, count(*) AS chunks, count(DISTINCT text) AS to_embed, count(*) - count(DISTINCT text) AS cache_hits FROM documents GROUP BY lang")
def content_dedup_cache_hits(spark, sf):
    """Through the cache itself: what ``embed_chunks`` embeds anew, and what it would find."""
    rows = _docs(spark, sf).select("lang", F.col("text").alias("content"))
    empty = spark.createDataFrame([], schema.CACHE)
    keyed, new = embed.embed_chunks(rows, empty, settings.Embedding(dimensions=8))
    met = keyed.join(new.select("content_hash"), "content_hash").groupBy("lang", "content_hash").agg(F.count("*").alias("n"))
    return met.groupBy("lang").agg(F.sum("n").alias("chunks"), F.count("*").alias("to_embed"), F.sum(F.col("n") - 1).alias("cache_hits"))


def _manifest(spark, sf):
    """The documents as they might have been: without one source's, with another's texts changed, and with files that are gone."""
    d = _docs(spark, sf)
    then = d.where("source != 'src3'").select(_path().alias("file_path"), F.when(F.col("source") == "src5", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    gone = d.where("source = 'src7'").select(F.concat(F.lit("old/"), _path()).alias("file_path"), "text")
    return then.unionByName(gone).select("file_path", tx.sha256_id(F.col("text")).alias("hash"))


_DIFF = """now AS (SELECT concat(source, '/', doc_id, '.txt') AS file_path, sha256(text) AS hash FROM documents),
was AS (SELECT concat(source, '/', doc_id, '.txt') AS file_path, sha256(CASE WHEN source = 'src5' THEN concat(text, '!') ELSE text END) AS hash FROM documents WHERE source <> 'src3'
  UNION ALL SELECT concat('old/', source, '/', doc_id, '.txt'), sha256(text) FROM documents WHERE source = 'src7'),
diff AS (SELECT coalesce(n.file_path, w.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN 'deleted' WHEN w.file_path IS NULL THEN 'new'
  WHEN n.hash = w.hash THEN 'unchanged' ELSE 'changed' END AS change FROM now n FULL OUTER JOIN was w ON n.file_path = w.file_path)"""


def _files(spark, sf):
    return _docs(spark, sf).select(_path().alias("file_path"), tx.sha256_id(F.col("text")).alias("hash"))


@query(f"WITH {_DIFF} SELECT file_path, change FROM diff")
def manifest_diff(spark, sf):
    return changes.changes(_files(spark, sf), _manifest(spark, sf))


@query(f"WITH {_DIFF} SELECT change, count(*) AS n FROM diff GROUP BY change")
def manifest_diff_counts(spark, sf):
    return changes.changes(_files(spark, sf), _manifest(spark, sf)).groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH {_DIFF} SELECT d.file_path, concat('sha256:', n.hash) AS hash FROM diff d JOIN now n ON d.file_path = n.file_path")
def manifest_update(spark, sf):
    files, old = _files(spark, sf), _manifest(spark, sf)
    diff = changes.changes(files, old)
    fresh = files.join(diff.where("change in ('new', 'changed')"), "file_path", "left_semi")
    return changes.next_manifest(old, fresh, diff.where("change = 'deleted'"))


@query("SELECT lang AS language, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang")
def language_histogram(spark, sf):
    return _chunks(spark, sf).where("language != ''").groupBy("language").agg(F.count("*").alias("n"))


@query(f"""WITH {_DIFF} SELECT (SELECT count(*) FROM was) AS total_files, (SELECT count(*) FROM documents) AS total_chunks,
(SELECT count(*) FROM diff WHERE change IN ('new', 'changed')) AS stale_files, (SELECT count(*) FROM diff WHERE change = 'deleted') AS deleted_files,
(SELECT count(DISTINCT lang) FROM documents) AS languages""")  # fmt: skip
def index_status(spark, sf):
    """What the stored index says of itself."""
    found = index.status(_store(spark, sf), _files(spark, sf), settings.Config())
    row = (found["total_files"], found["total_chunks"], found["stale_files"], found["deleted_files"], len(found["languages"]))
    return spark.createDataFrame([row], "total_files long, total_chunks long, stale_files long, deleted_files long, languages long")


_BYTES = "octet_length(encode(text))"


@query(f"SELECT concat(source, '/', doc_id, '.txt') AS file_path, concat('sha256:', sha256(text)) AS hash, {_BYTES} AS file_size_bytes FROM documents")
def index_update(spark, sf):
    """The manifest after a build of other files (some texts differ, some files are gone since, some are new) and an update."""
    store = Store(spark, new_path(spark, "updated"))
    config = settings.Config(embedding=settings.Embedding(dimensions=8), chunking=Chunking(min_tokens=1))
    as_files = lambda d: d.select("file_path", F.col("text").cast("binary").alias("content"), tx.sha256_id(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("file_size_bytes"))
    now = _docs(spark, sf).select(_path().alias("file_path"), "text", "source")
    was = now.where("source != 'src3'").withColumn("text", F.when(F.col("source") == "src5", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    gone = now.where("source = 'src7'").withColumn("file_path", F.concat(F.lit("old/"), "file_path"))
    for files in (was.unionByName(gone), now):
        index.build(spark, store, as_files(files), config)
    return store.read("manifest").select("file_path", "hash", "file_size_bytes")


_EXT = "CASE lang WHEN 'en' THEN 'PY' WHEN 'de' THEN 'tsx' WHEN 'fr' THEN 'h' ELSE 'xyz' END"


@query(f"""SELECT doc_id, concat(source, '/', doc_id, '.', {_EXT}) AS file_path, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' WHEN 'fr' THEN 'c' END AS language,
lang IN ('en', 'de', 'fr') AS wanted FROM documents""")  # fmt: skip
def lang_detect(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.expr(_EXT)).alias("file_path"))
    return d.select("doc_id", "file_path", tx.language(F.col("file_path")).alias("language"), tx.extension(F.col("file_path")).isin(*tx.LANGUAGES).alias("wanted"))


@query("""SELECT doc_id, octet_length(encode(text)) AS size_bytes FROM documents
WHERE octet_length(encode(text)) <= CASE WHEN lang = 'fr' THEN 16 * 1024 ELSE 2 * 1024 END""")
def size_filter(spark, sf):
    """Office files (here: French texts) have a limit of their own. By the scan's own test."""
    limits = settings.Indexing(max_file_size_kb=2, max_office_file_size_kb=16)
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".docx").otherwise(".txt"))
    d = _docs(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), name.alias("file_path"))
    return _admitted(d, [], limits).select("doc_id", "size_bytes")


def _admitted(files: DataFrame, rules: list[Rules], limits: settings.Indexing) -> DataFrame:
    """Rows (file_path, size_bytes and more) that a scan takes."""

    def run(frames):
        for frame in frames:
            yield frame[[admits(p, int(n), rules, limits) for p, n in zip(frame["file_path"], frame["size_bytes"])]]

    return files.mapInPandas(run, files.schema)


@query(f"""SELECT concat(source, '/', doc_id, '.txt') AS file_path, {_BYTES} AS size_bytes FROM documents
WHERE NOT (source = 'src3' AND doc_id % 10 <> 7) AND NOT regexp_matches(concat(source, '/', doc_id, '.txt'), '/[0-9]*5[.]txt$') AND source <> 'src11' AND {_BYTES} <= 500 * 1024""")  # fmt: skip
def ignore_rules(spark, sf):
    """Patterns of ignore files, the last that matches counting."""
    d = _docs(spark, sf).select(_path().alias("file_path"), F.octet_length("text").cast("long").alias("size_bytes"))
    return _admitted(d, [Rules(["src3/*", "!src3/*7.txt", "*5.txt", "src11/**"])], settings.Indexing())


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_stripped FROM documents")
def line_numbers(spark, sf):
    return _docs(spark, sf).select("doc_id", (tx.line_breaks(F.col("text")) + 1).cast("long").alias("end_line"), F.length(tx.strip(F.col("text"))).cast("long").alias("n_stripped"))


@query("SELECT page_id, url, regexp_matches(url, '^https?://[^/]+/.*$') AS under_host FROM pages WHERE regexp_matches(url, '^https?:/(/[^/]+)+/[^/]*$')")
def glob_urls(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return p.where(F.col("url").rlike("^https?:/(/[^/]+)+/[^/]*$")).withColumn("under_host", tx.matches_glob(F.col("url"), "http*://*/**"))


# Updates


@query("WITH " + _TOKENS + """, kept AS (SELECT doc_id FROM documents WHERE source <> 'src4')
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM (SELECT t.doc_id, term, count(*) AS tf FROM tok t JOIN kept USING (doc_id) GROUP BY ALL) GROUP BY term""")  # fmt: skip
def delete_by_file(spark, sf):
    chunks = _chunks(spark, sf)
    kept = bm25.delete_by_file(bm25.counted(chunks), chunks, chunks.where("file_path like 'src4/%'").select("file_path"))
    return bm25.unfold(kept).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {_TOKENS} SELECT doc_id AS id, term, count(*) AS tf FROM tok GROUP BY ALL")
def incremental_equals_full(spark, sf):
    """Two sources indexed with other texts first, then again as they are."""
    chunks = _chunks(spark, sf)
    late = F.col("file_path").rlike("^src(2|9)/")
    old = bm25.counted(chunks.withColumn("content", F.when(late, F.reverse("content")).otherwise(F.col("content"))))
    return bm25.unfold(bm25.add(old, bm25.counted(chunks.where(late)))).select("id", "term", F.col("tf").cast("long").alias("tf"))


@query("""SELECT conv_id, count(*) AS chunks, min(turn) AS start_line, max(turn) AS end_line, sum(length(text)) AS n_chars,
sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS content_hash FROM conversations GROUP BY conv_id""")  # fmt: skip
def merge_turns(spark, sf):
    """Neighbouring chunks joined by a blank line, line numbers as a range."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    g = c.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.min("turn").alias("start_line"), F.max("turn").alias("end_line"), F.sum(F.length("text")).alias("n_chars"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return g.withColumn("content_hash", F.sha2(F.array_join("_t.text", "\n\n"), 256)).drop("_t")


# Chunkers, as table functions


def _chunked(files: DataFrame, limits: Chunking) -> DataFrame:
    chunks, _ = chunk_files(files, limits)
    return chunks.select("id", "file_path", "start_line", "end_line", "chunk_type", "language", "symbol_name", "token_count")


_LETTER = "\\p{L}\\p{N}_"


def _packed_sql(source: str) -> str:
    """The text chunker in SQL over (path, content): blocks between blank lines, packed one after another up to 512 tokens; chunks below 20 go."""
    breaks = "length({0}) - length(replace({0}, chr(10), ''))"
    return f"""WITH RECURSIVE src AS ({source}),
raw AS (SELECT path, string_split_regex(content, '\n\n+') AS parts, regexp_extract_all(content, '\n\n+') AS gaps FROM src),
cut AS (SELECT path, i, parts[i] AS part, gaps[i] AS gap FROM (SELECT path, parts, gaps, unnest(range(1, len(parts) + 1)) AS i FROM raw)),
placed AS (SELECT path, i, part, len(regexp_extract_all(part, '[{_LETTER}]+|[^{_LETTER}\\s]')) AS n,
  1 + coalesce(sum({breaks.format("part")} + coalesce(length(gap), 0)) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM cut),
block AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM placed WHERE regexp_matches(part, '\\S')),
held AS (SELECT path, k, n AS size, 1 AS g FROM block WHERE k = 1
  UNION ALL SELECT b.path, b.k, CASE WHEN h.size + b.n > 512 THEN b.n ELSE h.size + b.n END, h.g + CASE WHEN h.size + b.n > 512 THEN 1 ELSE 0 END FROM held h JOIN block b ON b.path = h.path AND b.k = h.k + 1),
chunk AS (SELECT b.path, string_agg(b.part, chr(10) || chr(10) ORDER BY b.k) AS content, min(b.line)::INT AS start_line, sum(b.n)::INT AS token_count
  FROM block b JOIN held h ON h.path = b.path AND h.k = b.k GROUP BY b.path, h.g)
SELECT concat('sha256:', sha256(concat(path, ':', start_line, ':', content))) AS id, path AS file_path, start_line, (start_line + {breaks.format("content")})::INT AS end_line,
  'unknown' AS chunk_type, 'text' AS language, '' AS symbol_name, token_count FROM chunk WHERE token_count >= 20"""


def _as_files(spark, sf, ext: str, content) -> DataFrame:
    return _docs(spark, sf).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("." + ext)).alias("file_path"), content.alias("content"))


@query(_packed_sql("SELECT concat(source, '/', doc_id, '.txt') AS path, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents"))
def chunk_text_blocks(spark, sf):
    """Every line break becomes a blank line, so that blocks are packed."""
    return _chunked(_as_files(spark, sf, "txt", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))), Chunking())


@query()
def chunk_markdown(spark, sf):
    """Each line after the first under a header of its own level."""
    return _chunked(_as_files(spark, sf, "md", F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n# "), F.col("source"), F.lit("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n## Part\n\n")))), Chunking())


@query()
def chunk_python(spark, sf):
    """Each document as a function with its text as documentation."""
    body = F.regexp_replace(F.col("text"), "[^A-Za-z \n.,]", "x")
    return _chunked(_as_files(spark, sf, "py", F.concat(F.lit("import os\n\n\ndef f"), F.col("doc_id").cast("string"), F.lit("():\n    '''"), F.replace(body, F.lit("\n"), F.lit("\n    ")), F.lit("'''\n"))), Chunking())


@query()
def chunk_dita(spark, sf):
    """Each document as a topic whose lines are sections."""
    safe = F.regexp_replace(F.col("text"), "[<>&]", " ")
    xml = F.concat(F.lit("<topic xml:lang='"), F.col("lang"), F.lit("'><title>"), F.col("source"), F.lit("</title><body><section>"), F.replace(safe, F.lit("\n"), F.lit("</section><section>")), F.lit("</section></body></topic>"))
    return _chunked(_as_files(spark, sf, "dita", xml), Chunking())


@query(_packed_sql("SELECT concat('pages/', page_id, '.txt') AS path, html AS content FROM pages"))
def chunk_pages(spark, sf):
    """Web pages packed as text."""
    p = spread(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"))
    return _chunked(p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("html").alias("content")), Chunking())

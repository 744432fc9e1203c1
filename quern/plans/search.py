"""Searching an index: modes, filters, threshold, fusion and reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Config
from quern.errors import ConfigError, QuernError
from quern.functions.embed import provider
from quern.functions.text import matches_glob, terms_of
from quern.operators import bm25, fusion, vector
from quern.operators.rerank import rerank
from quern.schema import HIT
from quern.store import Store


@dataclass(frozen=True)
class Query:
    """What to look for. None, and 0 for top_k, stand for the settings' defaults."""

    text: str
    top_k: int | None = None
    threshold: float | None = None
    mode: str | None = None
    alpha: float | None = None
    language: str | None = None
    path: str | None = None
    rerank: bool | None = None

    def __post_init__(self):
        if not 1 <= len(self.text) <= 2000:
            raise ConfigError("a query has 1 to 2000 characters")
        if self.top_k is not None and not 0 <= self.top_k <= 100:
            raise ConfigError("top_k is from 0 to 100")
        if self.alpha is not None and not 0 <= self.alpha <= 1:
            raise ConfigError("alpha is from 0 to 1")
        if self.mode is not None and self.mode not in ("vector", "keyword", "hybrid"):
            raise ConfigError("mode is vector, keyword or hybrid")


def filters(q: Query) -> Column | None:
    out = F.col("language") == q.language if q.language else None
    if q.path:
        glob = matches_glob(F.col("file_path"), q.path)
        out = glob if out is None else out & glob
    return out


def combine(found_v: DataFrame | None, found_b: DataFrame | None, mode: str, alpha: float, fallback: str = "") -> tuple[DataFrame, bool]:
    """The list a mode gives, and whether it is fused. A hybrid search fuses two lists that both have
    hits; with one of them empty it gives the vector list as it is, so nothing if that one is the
    empty one, unless ``fallback`` is "keyword". Both lists are short and written before they are looked at.
    """
    if mode == "keyword":
        return found_b, False
    if mode == "vector" or found_b is None or found_b.isEmpty():
        return found_v, False
    if found_v.isEmpty():
        return (found_b if fallback == "keyword" else found_v), False
    return fusion.fuse(found_v, found_b, alpha), True


def _short(hits: DataFrame) -> DataFrame:
    """A list of a few rows, as it now is."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def search(store: Store, q: Query, config: Config) -> DataFrame:
    """rank, score and the hit's columns; after fusion also vector_score and bm25_score, after reranking rerank_score.

    Each list is asked for twice as many hits as wanted. The threshold is on a list's own score, and
    fused lists have none.
    """
    s = config.search
    top_k, mode = q.top_k or s.default_top_k, q.mode or s.mode
    threshold = s.default_threshold if q.threshold is None else q.threshold
    alpha = s.hybrid_alpha if q.alpha is None else q.alpha
    has_chunks, has_words = store.has("chunks"), store.known("postings")
    if mode != "keyword" and not has_chunks:
        raise QuernError("there is no index; build it first")
    if mode == "keyword" and not (has_words and has_chunks):
        raise QuernError("there is no keyword index; build it first")
    chunks = store.read("chunks")
    where = filters(q)
    # Lists are of ids and scores; filters read paths and languages, and nothing reads a content before the cut.
    about = ["id"] + ["language"] * bool(q.language) + ["file_path"] * bool(q.path)
    found_v = found_b = None
    if mode != "keyword":
        found_v = vector.search(chunks.select(*about, "vector"), provider(config.embedding).embed_query(q.text), 2 * top_k, where).select("id", "score")
    if mode != "vector" and has_words:
        narrow = chunks.select(*about) if where is not None else None
        found_b = bm25.search(q.text, store.query_postings(terms_of(q.text)), None, store.read("stats"), 2 * top_k, where, narrow).select("id", "score")
    # At most 2 * top_k rows each, 200 in all.
    found_v, found_b = (x if x is None else _short(x) for x in (found_v, found_b))
    merged, fused = combine(found_v, found_b, mode, alpha, s.fallback)
    score = "fused_score" if fused else "score"
    if mode != "hybrid":
        merged = merged.where(F.col("score") >= threshold)
    best = _short(merged.orderBy(F.desc(score), "id").limit(top_k))
    best = store.fetch([r["id"] for r in best.select("id").collect()]).join(F.broadcast(best), "id")
    if s.rerank_enabled if q.rerank is None else q.rerank:
        best = rerank(best, q.text, s.rerank_top_n, s.rerank_model, F.desc(score))
        order = [F.desc("rerank_score"), F.desc(score), F.col("id")]
        final = F.coalesce("rerank_score", score)
    else:
        order, final = [F.desc(score), F.col("id")], F.col(score)
    extra = [c for c in ("vector_score", "bm25_score", "rerank_score") if c in best.columns]
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), final.alias("score"), *HIT, *extra)

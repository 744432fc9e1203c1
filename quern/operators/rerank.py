"""Reranking of a result list by a scorer of (query, content)."""

from __future__ import annotations

import functools
import importlib.util
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import terms, terms_of

Scorer = Callable[[str, list[str]], list[float]]
_SCORERS: dict[str, Callable[[], Scorer]] = {}
#: Made once in a worker: a model may take long to load.
_made: dict[str, Scorer] = {}
_log = logging.getLogger(__name__)


def cross_encoder(model: str) -> Scorer:
    """A cross-encoder of the optional package sentence-transformers."""
    from sentence_transformers import CrossEncoder

    loaded = CrossEncoder(model)
    return lambda query, contents: [float(x) for x in loaded.predict([(query, c) for c in contents])]


def scorer(model: str) -> Callable[[], Scorer] | None:
    """What makes the scorer of that name: a registered one, or a cross-encoder if the package is there."""
    if model in _SCORERS:
        return _SCORERS[model]
    if importlib.util.find_spec("sentence_transformers") is not None:
        return functools.partial(cross_encoder, model)
    return None


def register(name: str, make: Callable[[], Scorer]) -> None:
    """Add a scorer. ``make`` runs in the worker that scores."""
    _SCORERS[name] = make


def _scores(model: str, make: Callable[[], Scorer], query: str, contents: list[str]) -> list[float]:
    """In a worker, where this module, and so what it has made, outlives the tasks."""
    if model not in _made:
        _made[model] = make()
    return _made[model](query, contents)


def overlap(query: str, content: Column) -> Column:
    """The share of the query's different terms that the content holds."""
    wanted = sorted(set(terms_of(query)))
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(terms(content), F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted)))


def rerank(hits: DataFrame, query: str, top_n: int, model: str = "term-overlap", order: Column | None = None) -> DataFrame:
    """The ``top_n`` best of ``hits`` by rerank_score, rounded to 4 places; ties stay in ``order``. Hits without content go.

    Where the model can't be had, or fails, the first ``top_n`` come in ``order`` with a null rerank_score.
    """
    rows = hits.where(F.trim(F.coalesce(F.col("content"), F.lit(""))) != "")
    if model == "term-overlap":
        scored = rows.withColumn("rerank_score", F.round(overlap(query, F.col("content")), 4))
    elif make := scorer(model):

        @F.pandas_udf("double")
        def by_model(content: pd.Series) -> pd.Series:
            return pd.Series(_scores(model, make, query, content.tolist()))

        try:
            scored = rows.withColumn("rerank_score", F.round(by_model("content"), 4))
            found = scored.orderBy(F.desc("rerank_score"), order if order is not None else F.col("id")).limit(top_n)
            return found.sparkSession.createDataFrame(found.collect(), found.schema)  # top_n rows; a scorer that fails is noticed here
        except Exception as exc:  # the list is worth more than its order
            return _unranked(hits, top_n, order, f"the reranker {model!r} failed: {exc}")
    else:
        return _unranked(hits, top_n, order, f"there is no reranker {model!r}")
    return scored.orderBy(F.desc("rerank_score"), order if order is not None else F.col("id")).limit(top_n)


def _unranked(hits: DataFrame, top_n: int, order: Column | None, why: str) -> DataFrame:
    """The first ``top_n`` in their order, without a score."""
    _log.warning("%s; the results keep their order", why)
    return hits.withColumn("rerank_score", F.lit(None).cast("double")).orderBy(order if order is not None else F.col("id"), "id").limit(top_n)

"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cosines(vectors: pa.ListArray, query: np.ndarray) -> pa.Array:
    """A batch's cosines as one product of a matrix."""
    q, norm = query, float(np.sqrt(query @ query))
    n = np.diff(vectors.offsets.to_numpy())
    use = (n == len(q)) & ~np.array(vectors.is_null())
    flat = vectors.values.to_numpy(zero_copy_only=False)
    first = vectors.offsets.to_numpy()[:-1][use]
    out = np.full(len(vectors), np.nan)
    if len(first) and len(q):
        m = flat[first[:, None] + np.arange(len(q))].astype(np.float64)
        with np.errstate(all="ignore"):
            made = m @ q / (np.sqrt((m * m).sum(1)) * norm)
        out[use] = np.where(np.isfinite(made), made, np.nan)
    return pa.array(out, mask=np.isnan(out))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """In doubles. The query's norm is a constant; a vector of zeros, of another length, or with a null or infinite element has no cosine (null)."""
    q = np.array([float(x) for x in query], np.float64)

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        return _cosines(v, q)

    return run(vector)


def search(chunks: DataFrame, query: Sequence[float], top_k: int | None, where: Column | None = None, vector_col: str = "vector", id_col: str = "id") -> DataFrame:
    """The ``top_k`` rows nearest to ``query`` for which ``where`` holds, with their score, the cosine rounded to 4 places.

    The filter comes before the search, in the scan. Scores are made in one pass, and each task
    keeps ``top_k`` rows alone. Equal scores go by id. Without ``top_k`` all rows come, in no order.
    """
    rows = chunks.where(where) if where is not None else chunks
    scored = rows.withColumn("score", F.round(cosine(F.col(vector_col), query), 4)).drop(vector_col)
    found = scored.where("score is not null")
    return found if top_k is None else found.orderBy(F.desc("score"), id_col).limit(top_k)

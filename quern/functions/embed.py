"""Embedding providers, the retry rules around them, and vectors for a table of chunks."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Embedding
from quern.errors import ConfigError, EmbeddingError, TooLargeError
from quern.functions.text import sha256_id

_TOO_LARGE = ("out of memory", "invalid buffer size", "context length", "maximum context", "too long", "too large")
LEAST_CHARS = 100
Vectors = list[list[float]]


class Provider(ABC):
    """Made once in each worker that uses it."""

    def __init__(self, settings: Embedding):
        self.settings = settings

    @property
    def model_name(self) -> str:
        return self.settings.model

    @property
    def dimensions(self) -> int:
        return self.settings.dimensions

    @abstractmethod
    def embed(self, texts: list[str]) -> Vectors:
        """A vector for each text, in order. ``TooLargeError`` asks for less at once."""

    def embed_query(self, text: str) -> list[float]:
        return self.embed([(self.settings.query_prefix + text)[: self.settings.max_embed_chars]])[0]


class HashProvider(Provider):
    """Signed feature hashing of words, of length 1; the same everywhere and without a model."""

    def embed(self, texts: list[str]) -> Vectors:
        from quern.functions.text import terms_of

        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in terms_of(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def retry_after(value: str | None) -> float | None:
    """The seconds a server asks for, if it names a finite positive number."""
    try:
        seconds = float(value or "")
    except ValueError:
        return None
    return seconds if math.isfinite(seconds) and seconds > 0 else None


def says_too_large(text: str) -> bool:
    return any(x in text.lower() for x in _TOO_LARGE)


def ordered(body: dict, n: int) -> list[list[float]]:
    """The vectors of a response by their index; anything missing is an error."""
    rows = body.get("data")
    if not isinstance(rows, list) or len(rows) != n:
        raise EmbeddingError(f"{n} vectors expected, {len(rows) if isinstance(rows, list) else 'none'} came")
    try:
        rows = sorted(rows, key=lambda r: r["index"])
        vectors = [r["embedding"] for r in rows]
    except (KeyError, TypeError) as exc:
        raise EmbeddingError("a vector without its index or values") from exc
    if [r["index"] for r in rows] != list(range(n)):
        raise EmbeddingError("indices that aren't 0 to n-1")
    return vectors


def _post(url: str, payload: dict, headers: dict, timeout: float) -> tuple[int, str, dict]:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace"), dict(r.headers)
    except urllib.error.HTTPError as exc:
        return exc.code, exc.read().decode("utf-8", "replace"), dict(exc.headers)


class RemoteProvider(Provider):
    """An HTTP service that takes {model, input} and returns {data: [{index, embedding}]}."""

    def __init__(self, settings: Embedding, post: Callable = _post, sleep: Callable[[float], None] = time.sleep):
        super().__init__(settings)
        if not settings.endpoint:
            raise ConfigError("embedding.endpoint must name the service")
        if not settings.api_key:
            raise ConfigError("embedding.api_key is missing")
        self.post, self.sleep = post, sleep

    def embed(self, texts: list[str]) -> Vectors:
        s, last = self.settings, "no attempt was made"
        for attempt in range(s.max_retries):
            wait = s.retry_delay_seconds * 2**attempt
            try:
                status, text, headers = self.post(s.endpoint, {"model": s.model, "input": texts}, {"Authorization": f"Bearer {s.api_key}"}, 60.0)
            except (OSError, TimeoutError) as exc:
                last = type(exc).__name__
            else:
                if status == 413 or (status in (400, 422) and says_too_large(text)):
                    raise TooLargeError(f"the service refused the length (status {status})")
                if status == 200:
                    try:
                        body = json.loads(text)
                    except ValueError as exc:
                        raise EmbeddingError("the answer isn't JSON") from exc
                    if "error" in body:  # an error in an answer that says success
                        if says_too_large(json.dumps(body["error"])):
                            raise TooLargeError("the service refused the length")
                        raise EmbeddingError("the service answered with an error")
                    return ordered(body, len(texts))
                last = f"status {status}"
                if status == 429:
                    wait = retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after")) or wait
            if attempt + 1 < s.max_retries:
                self.sleep(wait)
        raise EmbeddingError(f"gave up after {s.max_retries} attempts: {last}")


class LocalProvider(Provider):
    """A sentence-transformers model, if that package is installed."""

    def __init__(self, settings: Embedding):
        super().__init__(settings)
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as exc:
            raise EmbeddingError("the package sentence-transformers isn't installed") from exc
        self.model = SentenceTransformer(settings.model, device=settings.device, trust_remote_code=settings.trust_remote_code)
        if (found := self.model.get_sentence_embedding_dimension()) != settings.dimensions:
            raise EmbeddingError(f"the model has {found} dimensions, the settings {settings.dimensions}")

    def embed(self, texts: list[str]) -> Vectors:
        try:
            return [list(map(float, v)) for v in self.model.encode(texts)]
        except RuntimeError as exc:
            if says_too_large(str(exc)):
                raise TooLargeError(str(exc)) from exc
            raise


_PROVIDERS: dict[str, Callable[[Embedding], Provider]] = {"hash": HashProvider, "remote": RemoteProvider, "openrouter": RemoteProvider, "local": LocalProvider, "huggingface": LocalProvider}


def register(name: str, make: Callable[[Embedding], Provider]) -> None:
    _PROVIDERS[name] = make


def provider(settings: Embedding) -> Provider:
    if settings.provider not in _PROVIDERS:
        raise ConfigError(f"there is no embedding provider {settings.provider!r}")
    return _PROVIDERS[settings.provider](settings)


def shortened(p: Provider, text: str) -> list[float]:
    """A single text cut by a quarter until the provider takes it, down to LEAST_CHARS."""
    while True:
        try:
            return p.embed([text])[0]
        except TooLargeError as exc:
            if len(text) <= LEAST_CHARS:
                raise EmbeddingError("a text is too large however short") from exc
            text = text[: max(LEAST_CHARS, len(text) * 3 // 4)]


def embed_batch(p: Provider, texts: list[str]) -> tuple[list[list[float]], int]:
    """Vectors in order and the number of calls that succeeded. A batch that is too large is halved, both halves next in turn."""
    s = p.settings
    full = [(s.document_prefix + t)[: s.max_embed_chars] for t in texts]
    todo = deque(range(i, min(i + s.batch_size, len(full))) for i in range(0, len(full), s.batch_size))
    out, calls = [], 0
    while todo:
        part = todo.popleft()
        try:
            out += p.embed([full[i] for i in part]) if len(part) > 1 else [shortened(p, full[part[0]])]
            calls += 1
        except TooLargeError:
            half = part.start + len(part) // 2
            todo.extendleft([range(half, part.stop), range(part.start, half)])
    if any(len(v) != p.dimensions for v in out):
        raise EmbeddingError(f"a vector hasn't {p.dimensions} dimensions")
    return out, calls


def content_key(settings: Embedding):
    """The cache's key: the content with all that shapes its vector besides model and dimensions."""
    shape = f"{settings.provider}:{settings.max_embed_chars}:{settings.document_prefix}:"
    return sha256_id(F.concat(F.lit(shape), F.col("content")))


def embed_chunks(chunks: DataFrame, cache: DataFrame, settings: Embedding) -> tuple[DataFrame, DataFrame]:
    """(chunks with vector, rows new to the cache). A content met before has its vector from the cache; equal contents are embedded once."""
    own = cache.where((F.col("model") == settings.model) & (F.col("dimensions") == settings.dimensions)).select("content_hash", "vector")
    keyed = chunks.withColumn("content_hash", content_key(settings))
    fresh = keyed.join(own, "content_hash", "left_anti").select("content_hash", "content").dropDuplicates(["content_hash"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = provider(settings)
        for frame in frames:
            vectors, _ = embed_batch(p, frame["content"].tolist())
            yield pd.DataFrame({"content_hash": frame["content_hash"], "model": settings.model, "dimensions": settings.dimensions, "vector": vectors})

    new = fresh.mapInPandas(run, "content_hash string, model string, dimensions int, vector array<float>")
    return keyed, new

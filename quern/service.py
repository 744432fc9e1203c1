"""One place for the three things a caller does with an index; errors come back as dicts."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from quern import config as settings
from quern.errors import ConfigError
from quern.plans.index import build_project, status
from quern.plans.search import Query, search
from quern.session import ship
from quern.sources.scan import scan
from quern.store import Store


def failure(exc: Exception) -> dict:
    return {"status": "error", "error": str(exc), "error_type": type(exc).__name__}


class IndexService:
    def __init__(self, spark: SparkSession, project: str, index: str | None = None):
        ship(spark)
        self.spark, self.project = spark, project
        self.config = settings.load(project)
        self.store = Store(spark, index or "file://" + str(settings.bootstrap(project).resolve() / "tables"))

    def build(self, full: bool = False, batch_size: int = 50) -> dict:
        """``batch_size`` (1 to 500): files to be indexed that one task takes."""
        try:
            if not 1 <= batch_size <= 500:
                raise ConfigError("batch_size is from 1 to 500")
            return build_project(self.spark, self.project, self.store, self.config, full, batch_size)
        except Exception as exc:  # a caller of the service gets every failure as a dict
            return failure(exc)

    def search(self, text: str, **options) -> dict:
        began = time.time()
        try:
            if options.get("top_k") is not None and not 1 <= options["top_k"] <= 100:
                raise ConfigError("top_k is from 1 to 100")
            q = Query(text, **options)
            rows = [r.asDict() for r in search(self.store, q, self.config).orderBy("rank").collect()]  # top_k rows at most
        except Exception as exc:
            return failure(exc)
        for r in rows:
            r.pop("id")
        return {"query": text, "mode": q.mode or self.config.search.mode, "results": rows, "total_results": len(rows), "search_duration_ms": round((time.time() - began) * 1000)}

    def status(self) -> dict:
        try:
            return status(self.store, scan(self.spark, self.project, self.config.indexing), self.config)
        except Exception as exc:
            return failure(exc)

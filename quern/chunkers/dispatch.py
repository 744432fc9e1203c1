"""From files to chunks, as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.chunkers import code, dita, markdown, office, text
from quern.chunkers.base import Chunk
from quern.config import Chunking
from quern.functions.text import LANGUAGES
from quern.schema import CHUNK

#: Characters and rows of chunks that a worker holds before it sends them on.
HELD, ROWS = 1 << 20, 1000
_OFFICE = {"pdf": office.chunk_pdf, "docx": office.chunk_docx, "pptx": office.chunk_pptx}


def language_of(path: str) -> str | None:
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return LANGUAGES.get(ext.lower()) if dot and stem else None


def chunk_bytes(data: bytes, path: str, limits: Chunking) -> list[Chunk]:
    """The chunks of one file. Bytes that aren't UTF-8 are replaced; a blank file has none."""
    language = language_of(path)
    if language in _OFFICE:
        return _OFFICE[language](data, path, limits)
    body = data.decode("utf-8", "replace")
    if not body.strip():
        return []
    if language == "markdown":
        return markdown.chunk_markdown(body, path, limits)
    if language in ("dita", "ditamap"):
        return dita.chunk_dita(body, path, language, limits)
    if language in code.DEFINITIONS:
        return code.chunk_code(body, path, language, limits)
    return text.chunk_text(body, path, language, limits)


def chunks_of(made: DataFrame) -> DataFrame:
    return made.where("error is null").drop("error")


def errors_of(made: DataFrame) -> DataFrame:
    return made.where("error is not null").select("file_path", "error")


def chunk_files(files: DataFrame, limits: Chunking) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of ``files``. Both read the files; to do so once, write ``chunk_rows``."""
    made = chunk_rows(files, limits)
    return chunks_of(made), errors_of(made)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    column = lambda f: [list(m.items()) if (m := r[f.name]) is not None else None for r in rows] if pa.types.is_map(f.type) else [r[f.name] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(column(f), f.type) for f in schema], schema=schema)


_MADE = T.StructType([*(T.StructField(f.name, f.dataType) for f in CHUNK.fields), T.StructField("error", T.StringType())])


def chunk_batches(batches: Iterable[pa.RecordBatch], limits: Chunking) -> Iterator[pa.RecordBatch]:
    """The chunks of batches of files, ``HELD`` characters or ``ROWS`` rows at a time."""
    fields, schema = [f.name for f in CHUNK.fields], to_arrow_schema(_MADE)
    rows, held = [], 0
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1)):
            path, data = path.as_py(), data.as_py()
            try:
                own = [c.row() | {"error": None} for c in chunk_bytes(data or b"", path, limits)]
            except Exception as exc:  # one file's fault
                own = [dict.fromkeys(fields) | {"file_path": path, "error": f"{type(exc).__name__}: {exc}"}]
            for row in own:
                rows.append(row)
                held += len(row["content"] or "")
                if held >= HELD or len(rows) >= ROWS:
                    yield _batch(rows, schema)
                    rows, held = [], 0
    if rows:
        yield _batch(rows, schema)


def chunk_rows(files: DataFrame, limits: Chunking) -> DataFrame:
    """The chunks of ``files`` (file_path, content binary; null content counts as empty) with a column ``error``: a file that fails gives a row with its error alone, and the
    others go on. To be written once, then taken apart by ``chunks_of`` and ``errors_of``. Besides the batch it was given, a worker holds
    one file's chunks and what it sends on at once."""
    run = lambda batches: chunk_batches(batches, limits)
    return files.select("file_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, _MADE)

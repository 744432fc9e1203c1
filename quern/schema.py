"""The tables' schemas."""

from pyspark.sql import types as T

CHUNK_TYPES = (
    "function",
    "class",
    "method",
    "module_level",
    "markdown_section",
    "markdown_frontmatter",
    "dita_topic",
    "dita_map",
    "pdf_page",
    "docx_section",
    "pptx_slide",
    "unknown",
)

_s, _i = T.StringType(), T.IntegerType()
CHUNK = T.StructType(
    [T.StructField(n, t, False) for n, t in (("id", _s), ("file_path", _s), ("start_line", _i), ("end_line", _i), ("content", _s), ("chunk_type", _s), ("language", _s), ("symbol_name", _s), ("token_count", _i))]
    + [T.StructField("metadata", T.MapType(_s, _s), True)]
)
VECTOR = T.ArrayType(T.FloatType())
STORED = T.StructType([*CHUNK.fields, T.StructField("vector", VECTOR, False)])
MANIFEST = T.StructType([T.StructField("file_path", _s), T.StructField("hash", _s), T.StructField("last_indexed", T.TimestampType()), T.StructField("chunk_count", _i), T.StructField("file_size_bytes", T.LongType())])
CACHE = T.StructType([T.StructField("content_hash", _s), T.StructField("model", _s), T.StructField("dimensions", _i), T.StructField("vector", VECTOR)])
ERRORS = T.StructType([T.StructField("file_path", _s), T.StructField("error", _s)])

#: Columns of a search hit, in order.
HIT = ("id", "file_path", "start_line", "end_line", "chunk_type", "symbol_name", "language", "content")

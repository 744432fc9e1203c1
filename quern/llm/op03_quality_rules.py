"""Quality rules by compression bands.

A document's zstandard ratio (bytes over compressed bytes) must lie in a band that depends on its
length, as short texts compress less; and of its fixed chunks no more than a share may lie
outside the band for chunks, so that a repetitive or random stretch inside a long document counts.

A null text counts as empty: no words, so the base rules fail it. Each row is judged by itself;
repeated rows give repeated results, and a ratio on a limit is within it. A very long text is compressed and counted whole. An empty table gives an
empty result. Only the id and text columns are read, so that others may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import spread

LEVEL = 3
#: (bytes below which the band holds, least ratio, largest ratio). Least ratios lie just under the lowest of real
#: prose at a band's lower edge and over random characters where the two differ: base64, and letters with digits, from
#: 512 bytes on, letters from 2 KB, hexadecimal from 8 KB. Below those the ratios of prose and noise overlap.
BANDS = (
    (128, 0.0, 2.4),
    (192, 1.0, 2.6),
    (256, 1.045, 2.6),
    (384, 1.09, 2.6),
    (512, 1.17, 2.6),
    (768, 1.3, 2.8),
    (1024, 1.34, 2.8),
    (1536, 1.45, 3.0),
    (2048, 1.6, 3.0),
    (3072, 1.69, 3.2),
    (4096, 1.74, 3.2),
    (8192, 1.78, 3.4),
    (16384, 1.92, 3.6),
    (32768, 2.0, 3.8),
    (1 << 62, 2.0, 4.2),
)
#: Bytes of a chunk; a last chunk of less than half joins the one before. Band of chunks, and the share of bytes that may lie outside.
CHUNK, CHUNK_BAND, OUTSIDE = 4096, (1.78, 3.4), 0.2
#: Base rules.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h, m = np.zeros(n, np.uint64), (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    m ^= m >> np.uint64(31)
    for j in range(window):
        h = h * np.uint64(0xD1342543DE82EF95) + m[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # Equal windows have equal hashes; those that share a hash are compared word by word.
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    at = np.flatnonzero(twin)
    _, inverse, times = np.unique(ids[at[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
    at = at[times[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def chunks_of(n: int, size: int = CHUNK) -> list[tuple[int, int]]:
    """Chunks of ``size`` bytes of which the last has at least half of that, if the text has."""
    k = max(1, n // size + (n % size >= size // 2)) if n else 0
    return [(i * size, n if i == k - 1 else (i + 1) * size) for i in range(k)]


def band_of(n: int) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in BANDS if n < below)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the base counts, base_failed, kept, and the ratios behind the verdict (ratio, chunk_outside: share of bytes)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, ratio double, chunk_outside double"

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        number = defaultdict(count().__next__)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                raw = text.encode()
                words = raw.split()
                if len(number) > 1_000_000:
                    number = defaultdict(count().__next__)
                repeated = repeated_words(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                dup, seen = 0, set()
                for line in raw.split(b"\n"):
                    if line in seen:
                        dup += 1
                    elif line.strip():
                        seen.add(line)
                spaces = len(raw) - len(raw.translate(None, SPACES))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                failed = len(words) < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
                ratio = len(raw) / len(squeeze.compress(raw)) if raw else 0.0
                outside = 0
                parts = chunks_of(len(raw))
                if len(parts) > 1:
                    for a, z in parts:
                        r = (z - a) / len(squeeze.compress(raw[a:z]))
                        outside += (z - a) * (not CHUNK_BAND[0] <= r <= CHUNK_BAND[1])
                share = outside / len(raw) if raw else 0.0
                low, high = band_of(len(raw))
                rows.append((len(words), len(text) - spaces, symbols, dup, repeated, failed, not failed and low <= ratio <= high and share <= OUTSIDE, ratio, share))
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            cols = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], names=[id_col, *names, "base_failed", "kept", "ratio", "chunk_outside"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)

"""Text without a format: packed at blank lines, or line by line."""

from __future__ import annotations

from quern.chunkers.base import Chunk, Lines, Maker, blocks, greedy
from quern.config import Chunking


def chunk_text(text: str, path: str, language: str | None, limits: Chunking) -> list[Chunk]:
    """Blocks between blank lines, packed up to the limit; one block above it stays whole."""
    make, line = Maker(path, language, "unknown", limits), Lines(text)
    return [c for part, at in greedy(blocks(text), make.most, make.count, "\n\n") for c in make.chunk(part, line(at))]


def chunk_lines(text: str, path: str, language: str | None, limits: Chunking) -> list[Chunk]:
    """Lines packed up to the limit, for texts that have no blank lines."""
    make, at, parts = Maker(path, language, "unknown", limits), 1, []
    for x in text.split("\n"):
        if x.strip():
            parts.append((x, at))
        at += 1
    return [c for part, n in greedy(parts, make.most, make.count, "\n") for c in make.chunk(part, n)]

"""What all chunkers share: the chunk, greedy packing, and cutting at blank lines."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from quern.config import Chunking
from quern.functions.tokens import counter

_GAP = re.compile(r"\n\n+")


def chunk_id(path: str, line: int, content: str) -> str:
    return "sha256:" + hashlib.sha256(f"{path}:{line}:{content}".encode("utf-8", "replace")).hexdigest()


@dataclass(frozen=True)
class Chunk:
    file_path: str
    content: str
    start_line: int
    end_line: int
    chunk_type: str
    language: str
    token_count: int
    symbol_name: str = ""
    metadata: dict = field(default_factory=dict)
    hashed: str | None = None

    @property
    def id(self) -> str:
        return chunk_id(self.file_path, self.start_line, self.content if self.hashed is None else self.hashed)

    def row(self) -> dict:
        # Values that aren't text become JSON.
        meta = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in self.metadata.items() if v is not None}
        return {"id": self.id, "file_path": self.file_path, "start_line": self.start_line, "end_line": self.end_line, "content": self.content, "chunk_type": self.chunk_type, "language": self.language, "symbol_name": self.symbol_name, "token_count": self.token_count, "metadata": meta}


class Maker:
    """Makes a file's chunks of one kind, and drops those below the least size."""

    def __init__(self, path: str, language: str, kind: str, limits: Chunking):
        self.path, self.language, self.kind = path, language or "", kind
        self.most, self.least = limits.max_tokens, limits.min_tokens
        self.tokens = counter(limits.tokens)
        self.count: Callable[[str], int] = self.tokens.count

    def chunk(self, text: str, line: int, end: int | None = None, kind: str | None = None, symbol: str | None = None, meta: dict | None = None, least: int | None = None) -> list[Chunk]:
        """The chunk alone in a list, or nothing if it is too small."""
        n = self.count(text)
        if n < (self.least if least is None else least):
            return []
        return [Chunk(self.path, text, line, line + text.count("\n") if end is None else end, kind or self.kind, self.language, n, symbol or "", dict(meta or {}))]


def blocks(text: str, blank: bool = False) -> list[tuple[str, int]]:
    """What blank lines separate, with its offset. Blocks of white space go, or with ``blank`` only a last one does."""
    out, at = [], 0
    for m in [*_GAP.finditer(text), None]:
        stop = m.start() if m else len(text)
        part = text[at:stop]
        if part and (part.strip() or (blank and m)):
            out.append((part, at))
        at = m.end() if m else stop
    return out


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str, first: int = 1):
        self.breaks, self.first = [m.start() for m in re.finditer("\n", text)], first

    def __call__(self, offset: int) -> int:
        return self.first + bisect_left(self.breaks, offset)


def greedy(parts: Iterable[tuple[str, int]], most: int, count: Callable[[str], int], joint: str) -> Iterator[tuple[str, int]]:
    """Parts joined while their own counts add up to no more than ``most``; a part that is larger stays whole."""
    held, size, start = [], 0, 0
    for part, at in parts:
        n = count(part)
        if held and size + n > most:
            yield joint.join(held), start
            held, size = [], 0
        if not held:
            start = at
        held.append(part)
        size += n
    if held:
        yield joint.join(held), start


def windows(text: str, most: int, tokens) -> list[str]:
    """``text`` in pieces of ``most`` tokens, shortened where a piece wouldn't encode to the same tokens again."""
    ids, out, at = tokens.encode(text), [], 0
    while at < len(ids):
        stop = min(at + most, len(ids))
        while stop > at + 1 and tokens.encode(tokens.decode(ids[at:stop])) != ids[at:stop]:
            stop -= 1
        if piece := tokens.decode(ids[at:stop]):
            out.append(piece)
        at = stop
    return out or [text]


def retype(c: Chunk, **changes) -> Chunk:
    return replace(c, **changes)

"""Markdown by its headers."""

from __future__ import annotations

import re

from quern.chunkers.base import Chunk, Lines, Maker, blocks, retype, windows
from quern.config import Chunking

_FRONT = re.compile(r"\A---\s*\n.*?\n---\s*(?:\n|\Z)", re.S)
_HEAD = re.compile(r"(#{1,6})\s+(.+)\Z")
_FENCE = re.compile(r"\s*(```|~~~)")


def _sections(lines: list[str], first: int, fences: bool) -> list[tuple[int, int, list[tuple[int, str]]]]:
    """(first line, line after the last, headers above and own) from line ``first`` on. ``fences``: headers inside fenced code don't count."""
    out, path, start, inside = [], [], first, False
    for i in range(first, len(lines)):
        if fences and _FENCE.match(lines[i]):
            inside = not inside
        m = None if inside else _HEAD.match(lines[i])
        if m:
            if i > first or path:
                out.append((start, i, path))
            level = len(m[1])
            path = [h for h in path if h[0] < level]
            # Headers of a lower rank that stand above a higher one end with it.
            path = path + [(level, m[2].strip())]
            start = i
    if start < len(lines):
        out.append((start, len(lines), path))
    return out


def chunk_markdown(text: str, path: str, limits: Chunking, fence_aware: bool = False) -> list[Chunk]:
    """Front matter and each header's section are chunks; larger sections are cut at blank lines, then lines, then tokens."""
    make = Maker(path, "markdown", "markdown_section", limits)
    out, lines, first = [], text.split("\n"), 0
    if front := _FRONT.match(text):
        whole = front[0]
        first = whole.count("\n")
        # The chunk's id is of the text as it stands, its content without white space around.
        out += [retype(c, content=whole.strip(), hashed=whole) for c in make.chunk(whole, 1, first, "markdown_frontmatter", meta={"header_path": [], "header_level": 0})]
    for start, stop, heads in _sections(lines, first, fence_aware):
        body = lines[start:stop]
        while body and not body[0].strip():
            body, start = body[1:], start + 1
        section = "\n".join(body).strip()
        if not section:
            continue
        meta = {"header_path": [t for _, t in heads], "header_level": heads[-1][0] if heads else 0}
        if make.count(section) <= make.most:
            out += make.chunk(section, start + 1, meta=meta)
        else:
            out += _cut(section, start + 1, make, meta)
    return out


def _cut(text: str, first: int, make: Maker, meta: dict) -> list[Chunk]:
    """Paragraphs packed up to the limit. What is left of one that had to be cut begins the next pack."""
    line, out = Lines(text, first), []
    held: list[str] = []
    size = start = 0

    def flush(parts: list[str], joint: str, at: int) -> None:
        if parts:
            out.extend(make.chunk(joint.join(parts), line(at), meta=meta))

    for para, at in blocks(text, blank=True):
        n = make.count(para)
        if held and size + n > make.most:
            flush(held, "\n\n", start)
            held, size = [], 0
        if n <= make.most:
            start = start if held else at
            held.append(para)
            size += n
            continue
        rows: list[str] = []
        began = place = at
        for row in para.split("\n"):
            if make.count(row) > make.most:
                flush(rows, "\n", began)
                *whole, rest = windows(row, make.most, make.tokens)
                for piece in whole:
                    out.extend(make.chunk(piece, line(place), line(place), meta=meta))
                rows, began = [rest], place
            else:
                if rows and make.count("\n".join([*rows, row])) > make.most:
                    flush(rows, "\n", began)
                    rows = []
                began = began if rows else place
                rows.append(row)
            place += len(row) + 1
        held, start = ["\n".join(rows)], began
        size = make.count(held[0])
    flush(held, "\n\n", start)
    return out

"""PDF pages, Word sections and slides.

Word and PowerPoint files are zip archives of XML and are read with the standard library. PDF
needs an optional package; without it a PDF gives nothing.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from posixpath import dirname, join, normpath

from quern.chunkers.base import Chunk, Maker, greedy
from quern.config import Chunking
from quern.errors import IndexingError

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        data = z.read(name)
    except KeyError:
        return None
    if b"<!ENTITY" in data:
        raise ValueError("entities are declared")
    return ET.fromstring(data)


def _core(z: zipfile.ZipFile, kind: str) -> dict:
    root = _xml(z, "docProps/core.xml")
    found = {} if root is None else {"title": root.findtext(_DC + "title"), "author": root.findtext(_DC + "creator")}
    return {f"{kind}_{k}": v for k, v in found.items() if v}


def _related(z: zipfile.ZipFile, name: str) -> list[tuple[str, str, str]]:
    """(id, kind, part) of what a part refers to."""
    root = _xml(z, join(dirname(name), "_rels", name.rpartition("/")[2] + ".rels"))
    if root is None:
        return []
    return [(r.get("Id", ""), r.get("Type", "").rpartition("/")[2], normpath(join(dirname(name), r.get("Target", ""))).lstrip("/")) for r in root]


def table_text(rows: list[list[str]]) -> str:
    made = [" | ".join(c.strip() for c in cells) for cells in rows]
    return "\n".join(r for r in made if r.strip())


def hard_split(text: str, make: Maker) -> list[str]:
    """At sentences, then words, then tokens; no piece is above the limit."""
    if make.count(text) <= make.most:
        return [text]
    sentences = text.replace(". ", ".\n").split("\n")
    out = []
    for part, _ in greedy(((s, 0) for s in sentences), make.most, make.count, " "):
        if make.count(part) <= make.most:
            out.append(part)
            continue
        for piece, _ in greedy(((w, 0) for w in part.split()), make.most, make.count, " "):
            if make.count(piece) <= make.most:
                out.append(piece)
            else:
                ids = make.tokens.encode(piece)
                out += [t for i in range(0, len(ids), make.most) if (t := make.tokens.decode(ids[i : i + make.most]))]
    return out


def split_paragraphs(text: str, line: int, make: Maker, meta: dict, least: int) -> list[Chunk]:
    """Paragraphs packed up to the limit, all at the same line number."""

    def one(t: str) -> list[Chunk]:
        return make.chunk(t, line, line, meta=meta, least=least)

    if make.count(text) <= make.most:
        return one(text)
    out, run = [], []
    for para in [*text.split("\n\n"), None]:
        if para is None or make.count(para) > make.most:
            for part, _ in greedy(((p, 0) for p in run), make.most, make.count, "\n\n"):
                out += one(part)
            run = []
            for piece in [] if para is None else hard_split(para, make):
                out += one(piece)
        else:
            run.append(para)
    return out


def _span(a: dict, b: dict) -> dict:
    """Both chunks' metadata; numbers of pages or slides become the first and the last."""
    out = a | b
    for one, first, last in (("page_number", "start_page", "end_page"), ("slide_number", "start_slide", "end_slide")):
        lo, hi = a.get(first, a.get(one)), b.get(last, b.get(one))
        if lo is not None and hi is not None:
            out.pop(one, None)
            out |= {first: lo, last: hi}
    return out


def merge_short(chunks: list[Chunk], make: Maker) -> list[Chunk]:
    """Neighbours of which one is too small are joined; what stays too small is dropped."""
    out: list[Chunk] = []
    for c in chunks:
        if out and (out[-1].token_count < make.least or c.token_count < make.least):
            a = out.pop()
            text = a.content + "\n\n" + c.content
            c = Chunk(a.file_path, text, a.start_line, c.end_line, a.chunk_type, a.language, make.count(text), a.symbol_name, _span(a.metadata, c.metadata))
        out.append(c)
    return [c for c in out if c.token_count >= make.least]


def _pages(parts: list[tuple[int, str, dict]], make: Maker) -> list[Chunk]:
    return merge_short([c for n, text, meta in parts for c in split_paragraphs(text, n, make, meta, 0)], make)


def chunk_pdf(data: bytes, path: str, limits: Chunking) -> list[Chunk]:
    try:
        import fitz
    except ImportError as exc:  # the file gets an error row, and is tried again when the package is there
        raise IndexingError("PDF files need the package PyMuPDF (fitz)") from exc
    make = Maker(path, "pdf", "pdf_page", limits)
    with fitz.open(stream=data, filetype="pdf") as doc:
        about = {"total_pages": len(doc)} | {f"pdf_{k}": v for k in ("title", "author") if (v := (doc.metadata or {}).get(k))}
        pages = [(i + 1, text, about | {"page_number": i + 1}) for i in range(len(doc)) if (text := doc[i].get_text("text").strip())]
    return _pages(pages, make)


def _para(p: ET.Element, text: str, tab: str, br: str) -> str:
    return "".join(e.text or "" if e.tag == text else "\t" if e.tag == tab else "\n" if e.tag == br else "" for e in p.iter()).strip()


def chunk_docx(data: bytes, path: str, limits: Chunking, merge_first: bool = False) -> list[Chunk]:
    """A section for each heading. Sections too small go before neighbours are joined; ``merge_first`` joins them instead."""
    make = Maker(path, "docx", "docx_section", limits)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        about, styles, doc = _core(z, "docx"), _xml(z, "word/styles.xml"), _xml(z, "word/document.xml")
    names = {} if styles is None else {s.get(_W + "styleId"): n.get(_W + "val", "") for s in styles.iter(_W + "style") if (n := s.find(_W + "name")) is not None}
    body = None if doc is None else doc.find(_W + "body")
    para = lambda p: _para(p, _W + "t", _W + "tab", _W + "br")
    sections, parts, path_now, level = [], [], [], 0

    def flush() -> None:
        if "".join(parts).strip():
            sections.append(("\n\n".join(parts), list(path_now), level))

    for e in [] if body is None else body:
        if e.tag == _W + "p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = "" if style is None else style.get(_W + "val", "")
            m = re.fullmatch(r"heading\s*(\d+)", names.get(key, key).lower().strip())
            text = para(e)
            if m:
                flush()
                level = int(m[1])
                path_now = path_now[: max(0, level - 1)] + [text]
                parts = [text]
            elif text:
                parts.append(text)
        elif e.tag == _W + "tbl":
            rows = [["\n".join(para(p) for p in c.iter(_W + "p")) for c in r.findall(_W + "tc")] for r in e.findall(_W + "tr")]
            if t := table_text(rows):
                parts.append(t)
    flush()
    made = []
    for i, (text, heads, depth) in enumerate(sections):
        made += split_paragraphs(text, i + 1, make, about | {"heading_path": heads, "heading_level": depth}, 0 if merge_first else make.least)
    return merge_short(made, make)


def _shapes(tree: ET.Element):
    """Shapes and tables in order, those inside groups as well."""
    for e in tree:
        if e.tag == _P + "grpSp":
            yield from _shapes(e)
        elif e.tag in (_P + "sp", _P + "graphicFrame"):
            yield e


def chunk_pptx(data: bytes, path: str, limits: Chunking) -> list[Chunk]:
    """A slide each: its shapes' paragraphs, tables and speaker notes."""
    make = Maker(path, "pptx", "pptx_slide", limits)
    para = lambda p: _para(p, _A + "t", "", _A + "br")
    slides = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck = _xml(z, "ppt/presentation.xml")
        targets = {i: part for i, _, part in _related(z, "ppt/presentation.xml")}
        order = [] if deck is None else [targets[s.get(_R + "id")] for s in deck.iter(_P + "sldId")]
        for number, name in enumerate(order, 1):
            root = _xml(z, name)
            tree = None if root is None else root.find(f"{_P}cSld/{_P}spTree")
            parts, title = [], ""
            for shape in [] if tree is None else _shapes(tree):
                if (table := shape.find(f".//{_A}tbl")) is not None:
                    parts.append(table_text([["\n".join(para(p) for p in c.iter(_A + "p")) for c in r.findall(_A + "tc")] for r in table.findall(_A + "tr")]))
                elif (frame := shape.find(_P + "txBody")) is not None:
                    own = [t for p in frame.findall(_A + "p") if (t := para(p))]
                    parts += own
                    ph = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    if ph is not None and ph.get("idx", "0") == "0":
                        title = "\n".join(own)
            notes = ""
            for _, kind, part in _related(z, name):
                if kind == "notesSlide" and (n := _xml(z, part)) is not None:
                    for s in n.iter(_P + "sp"):
                        ph = s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                        if ph is not None and ph.get("type") == "body":
                            notes = "\n".join(t for p in s.iter(_A + "p") if (t := para(p)))
            if notes:
                parts.append(f"[Speaker notes] {notes}")
            text = "\n\n".join(p for p in parts if p)
            if text.strip():
                slides.append((number, text, {"slide_number": number, "has_notes": bool(notes)} | ({"slide_title": title} if title else {})))
    return _pages([(n, t, {"total_slides": len(order)} | m) for n, t, m in slides], make)

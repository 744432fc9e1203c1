"""Source code by its definitions.

Python is read with the standard library. Other languages need an optional grammar package; a
file whose grammar is missing, or that doesn't parse, is packed at blank lines like text.
"""

from __future__ import annotations

import ast
import importlib
from dataclasses import dataclass, field
from functools import cache

from quern.chunkers.base import Chunk, Lines, Maker, blocks, greedy
from quern.chunkers.text import chunk_text
from quern.config import Chunking


@dataclass
class Node:
    """A node of a syntax tree. Lines count from 1; offsets are of bytes."""

    type: str
    start: int
    end: int
    first: int
    last: int
    children: list[Node] = field(default_factory=list)
    text: str = ""
    name: str | None = None


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


#: Definitions that become chunks, by language.
DEFINITIONS = {
    "c": _words("declaration enum_specifier function_definition struct_specifier type_definition"),
    "cpp": _words("class_specifier declaration enum_specifier function_definition namespace_definition struct_specifier template_declaration type_definition"),
    "go": _words("function_declaration method_declaration type_declaration"),
    "java": _words("annotation_type_declaration class_declaration enum_declaration interface_declaration record_declaration"),
    "javascript": _words("class_declaration export_statement function_declaration lexical_declaration"),
    "php": _words("class_declaration enum_declaration function_definition interface_declaration trait_declaration"),
    "python": _words("class_definition decorated_definition function_definition"),
    "ruby": _words("class method module singleton_method"),
    "rust": _words("const_item enum_item function_item impl_item macro_definition static_item struct_item trait_item type_item"),
    "typescript": _words("class_declaration export_statement function_declaration interface_declaration lexical_declaration type_alias_declaration"),
}
#: What is a method inside a class, by language.
METHODS = {
    "cpp": _words("function_definition"),
    "java": _words("constructor_declaration method_declaration"),
    "javascript": _words("method_definition"),
    "php": _words("method_declaration"),
    "python": _words("function_definition"),
    "ruby": _words("method singleton_method"),
    "rust": _words("function_item"),
    "typescript": _words("method_definition public_field_definition"),
}
_HOLDERS = _words(
    "annotation_type_declaration class_specifier enum_declaration enum_item enum_specifier impl_item interface_declaration module namespace_definition record_declaration struct_item struct_specifier trait_declaration trait_item"
)
_LEVEL = _words("const_item declaration export_statement lexical_declaration macro_definition static_item template_declaration type_alias_declaration type_declaration type_definition type_item")
_BODIES = _words("block body body_statement class_body declaration_list enum_body field_declaration_list statement_block")
_NAMES = _words("constant field_identifier identifier name property_identifier type_identifier")
_GRAMMARS = {k: (f"tree_sitter_{k}", "language") for k in DEFINITIONS} | {"typescript": ("tree_sitter_typescript", "language_typescript"), "php": ("tree_sitter_php", "language_php")}


def is_holder(kind: str) -> bool:
    return "class" in kind or kind in _HOLDERS


def chunk_type(kind: str) -> str:
    if "class" in kind:
        return "class"
    if "function" in kind or kind in ("method", "method_declaration", "singleton_method"):
        return "function"
    return "class" if kind in _HOLDERS else "module_level" if kind in _LEVEL else "unknown"


def symbol(n: Node) -> str | None:
    """The name a definition gives: of the thing decorated, exported or templated; of the type an ``impl`` is for."""
    if n.name is not None:
        return n.name
    kids = n.children
    first = lambda kinds, nodes: next((k.text for k in nodes if k.type in kinds), None)
    if n.type == "decorated_definition":
        return next((symbol(k) for k in kids if k.type in ("class_definition", "function_definition")), None)
    if n.type in ("export_statement", "template_declaration"):
        return next((s for s in map(symbol, kids) if s), None)
    if n.type == "impl_item":
        at = next((i for i, k in enumerate(kids) if k.type == "for"), -1)
        return first(("generic_type", "scoped_type_identifier", "type_identifier"), kids[at + 1 :])
    if n.type == "type_declaration":
        spec = next((k for k in kids if k.type == "type_spec"), None)
        return spec and (first(("type_identifier",), spec.children) or symbol(spec))
    if n.type in ("class_specifier", "enum_specifier", "namespace_definition", "struct_specifier"):
        return first(("identifier", "name", "namespace_identifier", "type_identifier"), kids)
    if n.type == "type_definition":
        return first(("type_identifier",), kids)
    if n.type == "function_definition":
        inner = next((k for k in kids if k.type == "function_declarator"), None)
        if inner and (s := first(("destructor_name", "field_identifier", "identifier", "qualified_identifier"), inner.children)):
            return s
    return first(_NAMES, kids)


def _python(source: bytes) -> list[Node] | None:
    """The module's statements; a class has a block of its own."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    begin = [0]
    for row in source.split(b"\n"):
        begin.append(begin[-1] + len(row) + 1)

    def node(s: ast.stmt) -> Node:
        start, end = begin[s.lineno - 1] + s.col_offset, begin[s.end_lineno - 1] + s.end_col_offset
        kind, kids = "statement", []
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "function_definition"
        elif isinstance(s, ast.ClassDef):
            kind = "class_definition"
            kids = [Node("block", start, end, s.lineno, s.end_lineno, [node(x) for x in s.body])]
        made = Node(kind, start, end, s.lineno, s.end_lineno, kids, name=getattr(s, "name", None) if kind != "statement" else None)
        if getattr(s, "decorator_list", None):
            first = s.decorator_list[0]
            at = source.rfind(b"@", 0, begin[first.lineno - 1] + first.col_offset)
            made = Node("decorated_definition", at, end, source.count(b"\n", 0, at) + 1, s.end_lineno, [made], name=made.name)
        return made

    return [node(s) for s in tree.body]


@cache
def _parser(language: str):
    """A parser of an installed grammar, or None. One for all files of a worker."""
    try:
        sitter = importlib.import_module("tree_sitter")
        package, attribute = _GRAMMARS[language]
        grammar = importlib.import_module(package)
        return sitter.Parser(sitter.Language(getattr(grammar, attribute)()))
    except (ImportError, AttributeError, KeyError, TypeError, ValueError):
        return None


def _grammar(source: bytes, language: str) -> list[Node] | None:
    if (parser := _parser(language)) is None:
        return None

    def node(n, depth: int) -> Node:
        kids = [node(k, depth + 1) for k in n.children] if depth < 5 else []
        return Node(n.type, n.start_byte, n.end_byte, n.start_point[0] + 1, n.end_point[0] + 1, kids, source[n.start_byte : n.end_byte].decode("utf-8", "replace"))

    return node(parser.parse(source).root_node, 0).children


def parse(source: bytes, language: str) -> list[Node] | None:
    return _python(source) if language == "python" else _grammar(source, language)


def _oversized(text: str, first: int, kind: str, name: str | None, make: Maker, meta: dict | None = None) -> list[Chunk]:
    """Cut at blank lines, or where there are none between lines. A line is never cut."""
    parts, joint = blocks(text, blank=True), "\n\n"
    if len(parts) < 2:
        joint, parts, at = "\n", [], 0
        for row in text.split("\n"):
            parts.append((row, at))
            at += len(row) + 1
    line = Lines(text, first)
    return [c for part, at in greedy(parts, make.most, make.count, joint) for c in make.chunk(part, line(at), kind=kind, symbol=name, meta=meta)]


def _fitting(text: str, n: Node, kind: str, name: str | None, make: Maker, meta: dict | None = None) -> list[Chunk]:
    if make.count(text) <= make.most:
        return make.chunk(text, n.first, n.last, kind, name, meta)
    return _oversized(text, n.first, kind, name, make, meta)


def _rest(source: bytes, start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[str, int]]:
    """What is left of a range, with its offsets."""
    out, at = [], start
    for a, z in [*sorted(taken), (end, end)]:
        if (gap := source[at:a].decode("utf-8", "replace")).strip():
            out.append((gap, at))
        at = max(at, z)
    return out


def _class(n: Node, source: bytes, language: str, make: Maker) -> list[Chunk]:
    """A large class: what is left without its methods comes first, then each method."""
    body = next((k for k in n.children if k.type in _BODIES), None)
    if body is None:
        return []
    kinds, owner = METHODS.get(language, frozenset()), symbol(n)
    out, taken = [], []
    for k in body.children:
        if k.type == "decorated_definition":
            method = any(x.type in kinds for x in k.children)
        elif language == "cpp" and k.type == "field_declaration":
            method = any(x.type == "function_declarator" for x in k.children)
        else:
            method = k.type in kinds
        if method:
            out += _fitting(source[k.start : k.end].decode("utf-8", "replace"), k, "method", symbol(k), make, {"parent_class": owner})
            taken.append((k.start, k.end))
    left = "\n".join(t.strip() for t, _ in _rest(source, n.start, n.end, taken))
    return (make.chunk(left, n.first, n.last, "class", owner) if left else []) + out


def chunk_code(text: str, path: str, language: str, limits: Chunking) -> list[Chunk]:
    """Each definition at the top level, then in one chunk all that is left. Definitions too small for a chunk are dropped."""
    source = text.encode("utf-8", "replace")
    nodes = parse(source, language) if language in DEFINITIONS else None
    if nodes is None:
        return chunk_text(text, path, language, limits)
    make = Maker(path, language, "unknown", limits)
    out, taken = [], []
    for n in nodes:
        if n.type not in DEFINITIONS[language]:
            continue
        taken.append((n.start, n.end))
        own = source[n.start : n.end].decode("utf-8", "replace")
        if is_holder(n.type) and make.count(own) > make.most and (parts := _class(n, source, language, make)):
            out += parts
        else:
            out += _fitting(own, n, chunk_type(n.type), symbol(n), make)
    if left := _rest(source, 0, len(source), taken):
        line_at = lambda at: source.count(b"\n", 0, at) + 1
        whole, first = "\n\n".join(t for t, _ in left), line_at(left[0][1])
        last = line_at(left[-1][1]) + left[-1][0].count("\n")
        out += _fitting(whole, Node("", 0, 0, first, last), "module_level", None, make)
    return out

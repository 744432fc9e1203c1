"""The path of languages with a grammar, from loading it to chunks, with a stand-in for the parser: it gives the tree that the grammar is known to make of each program."""

import sys
import types

import pytest

from quern.chunkers import code
from quern.config import Chunking

#: language: (program, [(node type, its text, [children]), ...], [(chunk type, symbol), ...])
PROGRAMS = {
    "go": (
        "package shapes\n\nfunc Add(a int) int {\n\treturn a\n}\n\ntype Shape struct {\n\tW int\n}\n\nfunc (s Shape) Area() int {\n\treturn s.W\n}\n",
        [("package_clause", "package shapes", []), ("function_declaration", "func Add(a int) int {\n\treturn a\n}", [("identifier", "Add", [])]), ("type_declaration", "type Shape struct {\n\tW int\n}", [("type_spec", "Shape struct {\n\tW int\n}", [("type_identifier", "Shape", [])])]), ("method_declaration", "func (s Shape) Area() int {\n\treturn s.W\n}", [("field_identifier", "Area", [])])],
        [("function", "Add"), ("module_level", "Shape"), ("function", "Area"), ("module_level", "")],
    ),
    "rust": (
        "use std::fmt;\n\nstruct Point { x: i32 }\n\nimpl fmt::Display for Point {\n    fn fmt(&self) {}\n}\n\nfn main() {}\n",
        [("use_declaration", "use std::fmt;", []), ("struct_item", "struct Point { x: i32 }", [("type_identifier", "Point", [])]), ("impl_item", "impl fmt::Display for Point {\n    fn fmt(&self) {}\n}", [("scoped_type_identifier", "fmt::Display", []), ("for", "for", []), ("type_identifier", "Point", [])]), ("function_item", "fn main() {}", [("identifier", "main", [])])],
        [("class", "Point"), ("class", "Point"), ("function", "main"), ("module_level", "")],
    ),
    "java": (
        "package a;\n\npublic class Box {\n    int size() { return 1; }\n}\n\ninterface Lid { void open(); }\n",
        [("package_declaration", "package a;", []), ("class_declaration", "public class Box {\n    int size() { return 1; }\n}", [("identifier", "Box", [])]), ("interface_declaration", "interface Lid { void open(); }", [("identifier", "Lid", [])])],
        [("class", "Box"), ("class", "Lid"), ("module_level", "")],
    ),
    "c": (
        "#include <stdio.h>\n\ntypedef int number;\n\nint add(int a, int b) {\n  return a + b;\n}\n",
        [("preproc_include", "#include <stdio.h>", []), ("type_definition", "typedef int number;", [("type_identifier", "number", [])]), ("function_definition", "int add(int a, int b) {\n  return a + b;\n}", [("function_declarator", "add(int a, int b)", [("identifier", "add", [])])])],
        [("module_level", "number"), ("function", "add"), ("module_level", "")],
    ),
    "cpp": (
        "namespace geo {\nint x;\n}\n\ntemplate <class T> class Stack {\n};\n\nvoid Stack::push() {\n}\n",
        [("namespace_definition", "namespace geo {\nint x;\n}", [("namespace_identifier", "geo", [])]), ("template_declaration", "template <class T> class Stack {\n}", [("class_specifier", "class Stack {\n}", [("type_identifier", "Stack", [])])]), ("function_definition", "void Stack::push() {\n}", [("function_declarator", "Stack::push()", [("qualified_identifier", "Stack::push", [])])])],
        [("class", "geo"), ("module_level", "Stack"), ("function", "Stack::push"), ("module_level", "")],
    ),
    "ruby": (
        "require 'set'\n\nmodule Tools\nend\n\nclass Cat\n  def meow\n  end\nend\n\ndef self.make\nend\n",
        [("call", "require 'set'", []), ("module", "module Tools\nend", [("constant", "Tools", [])]), ("class", "class Cat\n  def meow\n  end\nend", [("constant", "Cat", [])]), ("singleton_method", "def self.make\nend", [("identifier", "make", [])])],
        [("class", "Tools"), ("class", "Cat"), ("function", "make"), ("module_level", "")],
    ),
    "php": (
        "<?php\n\nfunction greet($n) { return $n; }\n\ntrait Loud { }\n\nenum Suit { case Hearts; }\n",
        [("php_tag", "<?php", []), ("function_definition", "function greet($n) { return $n; }", [("name", "greet", [])]), ("trait_declaration", "trait Loud { }", [("name", "Loud", [])]), ("enum_declaration", "enum Suit { case Hearts; }", [("name", "Suit", [])])],
        [("function", "greet"), ("class", "Loud"), ("class", "Suit"), ("module_level", "")],
    ),
    "javascript": (
        "import x from 'x';\n\nexport function run(a) { return a; }\n\nclass Car { drive() {} }\n",
        [("import_statement", "import x from 'x';", []), ("export_statement", "export function run(a) { return a; }", [("function_declaration", "function run(a) { return a; }", [("identifier", "run", [])])]), ("class_declaration", "class Car { drive() {} }", [("identifier", "Car", [])])],
        [("module_level", "run"), ("class", "Car"), ("module_level", "")],
    ),
    "typescript": (
        "import x from 'x';\n\ninterface Named { name: string }\n\ntype Id = string;\n\nfunction pick(a: Id) { return a; }\n",
        [("import_statement", "import x from 'x';", []), ("interface_declaration", "interface Named { name: string }", [("type_identifier", "Named", [])]), ("type_alias_declaration", "type Id = string;", [("type_identifier", "Id", [])]), ("function_declaration", "function pick(a: Id) { return a; }", [("identifier", "pick", [])])],
        [("class", "Named"), ("module_level", "Id"), ("function", "pick"), ("module_level", "")],
    ),
}


def fake_node(source: bytes, kind: str, text: str, children: list, start: int = 0):
    at = source.index(text.encode(), start)
    end = at + len(text.encode())
    point = lambda o: (source.count(b"\n", 0, o), o - source.rfind(b"\n", 0, o) - 1)
    return types.SimpleNamespace(type=kind, start_byte=at, end_byte=end, start_point=point(at), end_point=point(end), children=[fake_node(source, *c, at) for c in children])


@pytest.fixture
def grammar(monkeypatch):
    """Installs a grammar package for a language, whose parser gives the trees it is told."""

    def install(language, spec):
        package, attribute = code._GRAMMARS[language]

        class Parser:
            def __init__(self, made):
                assert made == ("a language", package)

            def parse(self, source):
                kids, at = [], 0
                for one in spec:
                    kids.append(fake_node(source, *one, at))
                    at = kids[-1].end_byte
                return types.SimpleNamespace(root_node=types.SimpleNamespace(type="program", start_byte=0, end_byte=len(source), start_point=(0, 0), end_point=(0, 0), children=kids))

        monkeypatch.setitem(sys.modules, "tree_sitter", types.SimpleNamespace(Parser=Parser, Language=lambda x: ("a language", x)))
        monkeypatch.setitem(sys.modules, package, types.SimpleNamespace(**{attribute: lambda: package}))
        code._parser.cache_clear()

    yield install
    code._parser.cache_clear()


@pytest.mark.parametrize("language", sorted(PROGRAMS))
def test_definitions(grammar, language):
    program, spec, want = PROGRAMS[language]
    grammar(language, spec)
    out = code.chunk_code(program, f"a.{language}", language, Chunking(min_tokens=1))
    assert [(c.chunk_type, c.symbol_name) for c in out] == want
    lines = program.split("\n")
    for c in out[:-1]:  # a definition's lines are where it stands
        assert c.content == "\n".join(lines[c.start_line - 1 : c.end_line]).rstrip(";") or c.content in "\n".join(lines[c.start_line - 1 : c.end_line])
    assert code.DEFINITIONS[language] and all(c.language == language for c in out)


def test_large_class_is_split(grammar):
    method = "  void m{0}() {{ " + "call(); " * 12 + "}}"
    body = "{\n" + "\n".join(method.format(i) for i in range(4)) + "\n}"
    program = "class Big " + body + "\n"
    grammar("java", [("class_declaration", program.strip(), [("identifier", "Big", []), ("class_body", body, [("method_declaration", method.format(i).strip(), [("identifier", f"m{i}", [])]) for i in range(4)])])])
    out = code.chunk_code(program, "Big.java", "java", Chunking(max_tokens=60, min_tokens=2))
    assert [(c.chunk_type, c.symbol_name) for c in out] == [("class", "Big")] + [("method", f"m{i}") for i in range(4)]
    assert all(c.metadata == {"parent_class": "Big"} for c in out[1:]) and [c.start_line for c in out] == [1, 2, 3, 4, 5]


def test_without_a_grammar_text_is_packed(monkeypatch):
    monkeypatch.setitem(sys.modules, "tree_sitter", None)
    code._parser.cache_clear()
    out = code.chunk_code(PROGRAMS["go"][0], "a.go", "go", Chunking(min_tokens=1))
    code._parser.cache_clear()
    assert len(out) == 1 and out[0].chunk_type == "unknown" and out[0].language == "go"

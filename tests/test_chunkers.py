import io
import zipfile

import pytest

from quern.chunkers import code, dita, markdown, office, text
from quern.chunkers.base import chunk_id
from quern.chunkers.dispatch import chunk_bytes, chunk_files
from quern.config import Chunking
from quern.functions.tokens import counter

SMALL = Chunking(max_tokens=12, min_tokens=2)
N = counter().count


def check(chunks, limits=SMALL):
    assert len({c.id for c in chunks}) == len(chunks)
    for c in chunks:
        assert c.start_line <= c.end_line and c.token_count >= limits.min_tokens and c.token_count == N(c.content)
    return chunks


def test_text_packs_blocks():
    t = "one two three\n\nfour five six\n\n\nseven " + "w " * 20 + "\n\nlast block here"
    got = check(text.chunk_text(t, "a.txt", "text", SMALL))
    assert [c.start_line for c in got] == [1, 6, 8] and got[0].content == "one two three\n\nfour five six"
    assert got[1].token_count == 21  # one block above the limit stays whole
    assert text.chunk_text("\n\n  \n\n", "a", None, SMALL) == []
    assert got[0].id == chunk_id("a.txt", 1, got[0].content)


def test_lines():
    got = check(text.chunk_lines("a b c d e\nf g h i j\n\nk l m n o", "a", None, SMALL))
    assert [(c.start_line, c.content) for c in got] == [(1, "a b c d e\nf g h i j"), (4, "k l m n o")]


MD = """---
title: x
---
before the first header

# One
text of one

## Two
text of two
### Three
deep text
# Four

```
# not a header
```
"""


def test_markdown_sections():
    got = markdown.chunk_markdown(MD, "a.md", Chunking(max_tokens=50, min_tokens=1))
    assert [c.metadata["header_path"] for c in got] == [[], [], ["One"], ["One", "Two"], ["One", "Two", "Three"], ["Four"], ["not a header"]]
    assert got[0].chunk_type == "markdown_frontmatter" and (got[0].start_line, got[0].end_line) == (1, 3)
    lines = MD.split("\n")
    for c in got[1:]:
        assert "\n".join(lines[c.start_line - 1 : c.end_line]) == c.content
    assert len(markdown.chunk_markdown(MD, "a.md", Chunking(max_tokens=50, min_tokens=1), fence_aware=True)) == len(got) - 1


def test_markdown_large_sections():
    body = "# H\n\n" + "\n\n".join(f"para {i} has six words" for i in range(4)) + "\n\n" + "w " * 30 + "\nshort line\n\nend of it all"
    got = check(markdown.chunk_markdown(body, "a.md", SMALL))
    assert all(c.token_count <= 12 + 2 for c in got) and got[-1].content.endswith("end of it all")
    assert sum(c.content.count("w ") + c.content.endswith("w") for c in got) >= 29


PY = '''import os

X = 1

@wraps(f)
def first(a):
    return a + 1


class Big:
    """A class that is larger than the limit of this test."""

    field = 3

    def method(self):
        return self.field

    @property
    def other(self):
        return 2


async def last():
    pass
'''


def test_python():
    got = check(code.chunk_code(PY, "a.py", "python", Chunking(max_tokens=25, min_tokens=2)), Chunking(min_tokens=2))
    by = {(c.chunk_type, c.symbol_name): c for c in got}
    assert {("unknown", "first"), ("class", "Big"), ("method", "method"), ("method", "other"), ("function", "last"), ("module_level", "")} == set(by)
    assert by["unknown", "first"].start_line == 5 and by["unknown", "first"].content.startswith("@wraps")
    assert by["method", "other"].content.startswith("@property") and by["method", "other"].metadata == {"parent_class": "Big"}
    assert "import os" in by["module_level", ""].content and "def" not in by["class", "Big"].content
    whole = code.chunk_code(PY, "a.py", "python", Chunking(max_tokens=500, min_tokens=2))
    assert [c.symbol_name for c in whole] == ["first", "Big", "last", ""]


def test_code_that_does_not_parse_or_has_no_grammar():
    assert code.chunk_code("def (:\n\nx y z w", "a.py", "python", SMALL)[0].chunk_type == "unknown"
    assert code.chunk_code("func main() { }\n\nfunc b() {}", "a.go", "go", SMALL)[0].language == "go"


def test_names_and_kinds():
    n = code.Node
    leaf = lambda t, s: n(t, 0, 0, 1, 1, [], s)
    impl = n("impl_item", 0, 0, 1, 1, [leaf("type_identifier", "Trait"), leaf("for", "for"), leaf("generic_type", "T<U>")])
    assert code.symbol(impl) == "T<U>"
    go = n("type_declaration", 0, 0, 1, 1, [n("type_spec", 0, 0, 1, 1, [leaf("type_identifier", "Server")])])
    assert code.symbol(go) == "Server"
    cc = n("function_definition", 0, 0, 1, 1, [leaf("primitive_type", "int"), n("function_declarator", 0, 0, 1, 1, [leaf("identifier", "main")])])
    assert code.symbol(cc) == "main" and code.symbol(n("export_statement", 0, 0, 1, 1, [leaf("export", "export"), n("class_declaration", 0, 0, 1, 1, [leaf("identifier", "K")])])) == "K"
    assert [code.chunk_type(k) for k in ("class_definition", "method", "impl_item", "const_item", "decorated_definition")] == ["class", "function", "class", "module_level", "unknown"]


TOPIC = """<concept id="c" xml:lang="en"><title>Title here</title><shortdesc>Short words.</shortdesc>
<prolog><metadata><keywords><keyword>alpha</keyword><keyword>beta</keyword></keywords><audience type="admin"/></metadata></prolog>
<conbody><p>Intro text.</p><section><p>First section {a}</p></section><section>Second section {b}</section></conbody>
<related-links><link href="x"/></related-links><topic id="n"><title>Nested one</title><body><p>inner words</p></body></topic></concept>"""


def test_dita():
    one = dita.chunk_dita(TOPIC.format(a="x", b="y"), "a.dita", "dita", Chunking(max_tokens=100, min_tokens=2))
    assert [c.symbol_name for c in one] == ["Title here", "Nested one"] and one[0].content.startswith("[audience: admin] [keywords: alpha, beta]")
    assert one[1].metadata["xml_lang"] == "en" and "inner" not in one[0].content
    cut = dita.chunk_dita(TOPIC.format(a="w " * 60, b="y " * 20), "a.dita", "dita", Chunking(max_tokens=50, min_tokens=2))
    assert [c.metadata.get("section_index") for c in cut] == [None, 1, 2, None] and cut[1].metadata["truncated"] and cut[1].token_count <= 50
    assert dita.chunk_dita("<a><b></a>", "a", "dita", SMALL) == dita.chunk_dita("<!DOCTYPE a [<!ENTITY x 'y'>]><topic/>", "a", "dita", SMALL) == []
    m = dita.chunk_dita("<map xml:lang='de'><title>M</title><topicref href='a.dita' navtitle='A' keys='k'><topicref><topicmeta><navtitle>B</navtitle></topicmeta></topicref></topicref></map>", "m.ditamap", "ditamap", Chunking(max_tokens=100, min_tokens=2))
    assert m[0].content == "Map: M\n\n- A (a.dita) [keys: k]\n  - B" and m[0].metadata["xml_lang"] == "de"
    spec = "<x:my xmlns:x='u' class='- topic/topic my/my '><t class='- topic/title '>Special one</t><b class='- topic/body '>body words</b></x:my>"
    assert dita.chunk_dita(spec, "a.dita", "dita", SMALL)[0].content == "Special one\nbody words"


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join(f"<w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr>" for a, b in (("a", "b"), ("c", "d"))) + "</w:tbl>"
    body = p("Intro words here now") + p("Head", "H1") + p("Text below the head") + table + p("Sub", "H2") + p("More text in sub")
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}">' + "".join(f'<w:style w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 2)) + "</w:styles>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c>')
    return f.getvalue()


def test_docx():
    got = office.chunk_docx(docx(), "a.docx", Chunking(min_tokens=2))
    assert [c.metadata["heading_path"] for c in got] == [[], ["Head"], ["Head", "Sub"]] and got[1].metadata["docx_title"] == "T"
    assert "a | b\nc | d" in got[1].content and [c.start_line for c in got] == [1, 2, 3]


def pptx():
    a, p, r = ("http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships")
    ns = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"'
    sp = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda n: f"<p:sld {ns}><p:cSld><p:spTree>{sp(f'Title {n}', '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}<p:grpSp>{sp(f'grouped words {n}')}</p:grpSp></p:spTree></p:cSld></p:sld>"
    rel = lambda items: '<Relationships xmlns="x">' + "".join(f'<Relationship Id="{i}" Type="t/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rel([("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")]))
        for n in (1, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", slide(n))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rel([("r1", "notesSlide", "../notesSlides/n1.xml")]))
        z.writestr("ppt/notesSlides/n1.xml", f"<p:notes {ns}><p:cSld><p:spTree>{sp('say this', '<p:ph type=' + chr(34) + 'body' + chr(34) + '/>')}</p:spTree></p:cSld></p:notes>")
    return f.getvalue()


def test_pptx():
    got = office.chunk_pptx(pptx(), "a.pptx", Chunking(min_tokens=4))
    assert got[0].content == "Title 2\n\ngrouped words 2" and "[Speaker notes] say this" in got[1].content
    assert got[1].metadata["slide_title"] == "Title 1" and got[0].metadata["total_slides"] == 2
    assert office.chunk_pptx(pptx(), "a.pptx", Chunking(min_tokens=7))[0].metadata | {} == {"total_slides": 2, "start_slide": 1, "end_slide": 2, "has_notes": True, "slide_title": "Title 1"}


def test_hard_split():
    make = office.Maker("a", "pdf", "pdf_page", Chunking(max_tokens=6, min_tokens=0))
    got = office.hard_split("One two three. Four five six. " + "seven " * 10 + "x" * 50, make)
    assert all(make.count(p) <= 6 for p in got) and "".join("".join(got).split()) == "".join(("One two three. Four five six. " + "seven " * 10 + "x" * 50).split())


def test_files_fail_one_by_one(spark):
    rows = [("a.md", b"# H\n\nsome words in here"), ("bad.docx", b"not a zip"), ("b.txt", b""), ("c.txt", None), ("d.pptx", pptx()), ("e.py", b"\xff\xfe bad bytes\n\nx = 1")]
    chunks, errors = chunk_files(spark.createDataFrame(rows, "file_path string, content binary"), Chunking(min_tokens=2))
    assert [r["file_path"] for r in errors.collect()] == ["bad.docx"]
    got = chunks.collect()
    assert {r["file_path"] for r in got} == {"a.md", "d.pptx", "e.py"} and all(r["language"] is not None for r in got)


def test_tokens(tmp_path):
    t = counter()
    for s in ("a b, c", "  lead", "trail  ", "", "ünï_x 1.5"):
        assert t.decode(t.encode(s)) == s
    import base64

    f = tmp_path / "r"
    f.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    assert counter(f"bpe:{f}").count("abc") == 3


@pytest.mark.parametrize("name", ["a.rst", "a.txt", "noext"])
def test_dispatch(name):
    assert chunk_bytes(b"some plain words of text", name, SMALL)[0].chunk_type == "unknown"


def test_a_worker_sends_chunks_on_as_they_come(monkeypatch):
    """What it holds doesn't grow with its batch of files."""
    import pyarrow as pa

    from quern.chunkers import dispatch

    body = "\n\n".join(f"# Part {i}\n\nsome words of text" for i in range(20)).encode()
    files = pa.RecordBatch.from_pydict({"file_path": [f"f{i}.md" for i in range(30)] + ["broken.pdf"], "content": [body] * 30 + [b"%PDF-1.4"]})
    whole = [x for b in dispatch.chunk_batches([files], Chunking(min_tokens=1)) for x in b.to_pylist()]
    assert len(whole) == 601 and whole[-1]["error"] and whole[0]["error"] is None and dict(whole[0]["metadata"])["header_level"] == "1"
    for held, rows in ((1 << 20, 25), (200, 1000)):
        monkeypatch.setattr(dispatch, "HELD", held)
        monkeypatch.setattr(dispatch, "ROWS", rows)
        made = list(dispatch.chunk_batches([files, files], Chunking(min_tokens=1)))
        assert max(b.num_rows for b in made) <= 25 and [x for b in made for x in b.to_pylist()] == whole * 2

"""Column expressions over text and paths."""

from __future__ import annotations

import glob
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BY_LANGUAGE = "c:c,h cpp:cpp,hpp dita:dita ditamap:ditamap docx:docx go:go java:java javascript:js,jsx markdown:md,mdx pdf:pdf php:php pptx:pptx python:py rst:rst ruby:rb rust:rs text:txt typescript:ts,tsx"
LANGUAGES = {x: k for k, v in (e.split(":") for e in _BY_LANGUAGE.split()) for x in v.split(",")}
OFFICE = ("pdf", "docx", "pptx")

#: Words that carry no meaning of their own and are left out of the keyword index.
STOP_WORDS = tuple(
    (
        "a above after again all an and are as at be been before being below between both by can could did do does during each "
        "every few for from further had has have he her here him his how i if in into is it its just may me might more most my no "
        "nor not of off on once only or other our out over own same shall she should so some such than that the their them then "
        "there these they this those through to too under very was we were what when where which who why will with would you your "
    ).split()
)


def sha256_id(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def chunk_id(path: Column, line: Column, content: Column) -> Column:
    """The same content at another place has another id. None of the three may be null."""
    return sha256_id(F.concat_ws(":", path, line.cast("string"), content))


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none. A leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Null for extensions that aren't known."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def line_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def terms(c: Column) -> Column:
    """The words of a text as the keyword index has them: ASCII letters and digits, camel case and
    snake case split, lower-cased, of two signs or more, without stop words. Null gives none."""
    return F.filter(F.transform(pieces(c), F.lower), is_term)


def pieces(c: Column) -> Column:
    """What the words are picked from: runs of letters and digits, camel case split."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+")


def is_term(t: Column) -> Column:
    return (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)


def terms_of(text: str) -> list[str]:
    """``terms`` of a query, on the driver."""
    words = re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text))
    stop = set(STOP_WORDS)
    return [w.lower() for w in words if len(w) >= 2 and w.lower() not in stop]


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` stays within a part of the path, ``**`` spans parts, names with a leading dot are like others."""
    return "^" + glob.translate(pattern.replace("\\", "/"), recursive=True, include_hidden=True, seps="/").replace(r"\Z", r"\z").replace(r"\z", "$(?![\\s\\S])")


def matches_glob(path: Column, pattern: str | None) -> Column:
    """An empty pattern matches all."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_regex(pattern)) if pattern else F.lit(True)

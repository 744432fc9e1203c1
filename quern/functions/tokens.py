"""Token counters that the chunkers are given.

``regex`` counts words and marks and needs no file; it is the default. ``bpe:<file>`` takes a
rank file of the tiktoken kind (``bpe:<file>:<pattern>`` with a pattern of its own), and any
other name an encoding that the tiktoken library can load.
"""

from __future__ import annotations

import re
from functools import cache

_TOKEN = re.compile(r"\s*(?:\w+|[^\w\s])|\s+\Z")
_COUNT = re.compile(r"\w+|[^\w\s]")
GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RegexTokens:
    """A token is a word or a mark, with the white space before it."""

    def encode(self, text: str) -> list[str]:
        return _TOKEN.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)

    def count(self, text: str) -> int:
        return sum(1 for _ in _COUNT.finditer(text))


class BpeTokens:
    def __init__(self, encoding):
        self.encoding = encoding

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return self.encoding.decode(tokens)

    def count(self, text: str) -> int:
        return len(self.encode(text))


@cache
def counter(name: str = "regex"):
    if name == "regex":
        return RegexTokens()
    import tiktoken

    if name.startswith("bpe:"):
        import base64

        path, _, pattern = name[4:].partition(":")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return BpeTokens(tiktoken.Encoding("file", pat_str=pattern or GPT2, mergeable_ranks=ranks, special_tokens={}))
    return BpeTokens(tiktoken.get_encoding(name))

"""Ignore rules in the manner of git: wildcards, anchoring, negation and folders."""

from __future__ import annotations

import re
from collections.abc import Iterable


def _regex(rule: str) -> str:
    out, i = [], 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if rule.startswith("**", i) and i + 2 == len(rule) and i and rule[i - 1] == "/":
            out.append(".+")
            break
        if c == "*":
            out.append("[^/]*")
            while rule.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := rule.find("]", i + 2)) > 0:
            body = rule[i + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "\\" and i + 1 < len(rule):
            i += 1
            out.append(re.escape(rule[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


class Rules:
    """Whether a path (folders end in a slash) is ignored: the last rule that meets it or a folder above it decides."""

    def __init__(self, lines: Iterable[str]):
        self.rules: list[tuple[bool, re.Pattern]] = []
        for line in lines:
            rule = line.rstrip("\n\r")
            rule = rule if rule.endswith("\\ ") else rule.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep = rule.startswith("!")
            rule = rule[1:] if keep else rule
            folder = rule.endswith("/")
            rule = rule.rstrip("/")
            if not rule:
                continue
            anchored = "/" in rule
            body = _regex(rule.lstrip("/"))
            # A rule meets what it names and all below; a folder rule meets folders alone.
            self.rules.append((keep, re.compile(("" if anchored else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + r"\Z", re.S)))

    def __call__(self, path: str) -> bool:
        path, out = path.replace("\\", "/"), False
        for keep, rule in self.rules:
            if rule.match(path):
                out = not keep
        return out


def read_rules(path) -> Rules:
    """Of a file; none if it isn't there."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return Rules(f)
    except OSError:
        return Rules(())

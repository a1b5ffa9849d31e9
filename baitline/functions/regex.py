"""Regex dialect translation.

The rule patterns are stated in Python/JavaScript syntax, where ``\\d`` and
``\\s`` are Unicode-aware; Java (Spark) and RE2 (DuckDB) read them as ASCII.
These helpers rewrite the two classes into explicit Unicode forms that both
engines understand (``\\p{Nd}``, ``\\x{HHHH}`` ranges), inside and outside
character classes, so the engines match what the original rules match.
"""
from __future__ import annotations

import re

from .rule import lit

# Python str-pattern \s (characters for which str.isspace() holds)
PY_SPACE = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# JavaScript \s (WhiteSpace and LineTerminator)
JS_SPACE = (r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}\x{FEFF}")


def _translate(pattern: str, space: str, unicode_digits: bool) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(space if in_class else f"[{space}]")
            elif nxt == "d" and unicode_digits:
                out.append(r"\p{Nd}")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class and out and out[-1] not in ("[", "[^"):
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def python_re(pattern: str) -> str:
    """A Python ``re`` pattern with Unicode ``\\d`` and ``\\s`` for Java / RE2."""
    return _translate(pattern, PY_SPACE, unicode_digits=True)


def ascii_first(pattern: str) -> str:
    """A pattern of ``python_re`` for Java whose "no white space" is decided at once for visible ASCII
    (a class is tested part by part, and white space has ten parts)."""
    return pattern.replace(f"[^{PY_SPACE}]", f"[!-~[^{PY_SPACE}]]")


def js_re(pattern: str) -> str:
    """A JavaScript pattern (Unicode ``\\s``, ASCII ``\\d``) for Java / RE2."""
    return _translate(pattern, JS_SPACE, unicode_digits=False)


def _tree(words: list[str]) -> str:
    """A pattern of words none of which begins another: shared beginnings are tested once, and of
    many first characters four at a time."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    if any("" in ends and len(ends) > 1 for ends in rest.values()):
        raise ValueError("one of the words begins another")
    ways = [re.escape(c) + (_tree(ends) if any(ends) else "") for c, ends in sorted(rest.items())]
    if len(ways) > 4:
        firsts = [re.escape(c) for c in sorted(rest)]
        groups = [(firsts[i:i + 4], ways[i:i + 4]) for i in range(0, len(ways), 4)]
        ways = [f"(?=[{first[0]}-{first[-1]}])(?:{'|'.join(group)})" for first, group in groups]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def occurring(text: str, words: list[str], left: str, right: str) -> str:
    """SQL array of the words' occurrences in a text between the patterns ``left`` and ``right``, found
    in one search; a lookahead, so that they may overlap (none may begin another)."""
    return f"regexp_extract_all({text}, {lit(f'(?=(?:{left})({_tree(words)})(?:{right}))')}, 1)"

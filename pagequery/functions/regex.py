"""ECMAScript patterns for Java's matcher."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

_SHAPE = re.compile(r"^(?:[^\\^$.|?*+()\[\]{}]|\\[^a-zA-Z0-9])+\(\.\*\??\)(?:[^\\^$.|?*+()\[\]{}]|\\[^a-zA-Z0-9])*$")


#: A pattern's parts: escapes, whole classes, opening parentheses with what marks them, anything else.
_PART = re.compile(r"(?P<escape>\\[\s\S]?)|(?P<class>\[(?P<not>\^?)(?P<body>(?:\\[\s\S]|[^\]\\])*)(?P<end>\]?))|(?P<open>\((?P<mark>\?[\s\S]?)?)|[\s\S]")
_IN_CLASS = re.compile(r"\\[\s\S]|&&|\[")
#: Escapes that mean the same to Java.
_SAME = set("dDwWsSbBnrtfxuc")


def groups(pattern: str) -> int:
    """Capturing groups: opening parentheses outside classes and escapes without a mark."""
    return sum(m["open"] == "(" for m in _PART.finditer(pattern))


def _escape(two: str, after: str, inside: bool) -> str:
    c = two[1]
    if c == "0" and not after.isdigit():
        return r"\x00"
    if c == "v" or (c == "b" and inside):
        return r"\x0B" if c == "v" else r"\x08"
    if c.isalpha() and c not in _SAME or c in "/\"'":
        return c
    return two


def _class(negated: bool, body: str) -> str:
    if not body:
        return r"[\s\S]" if negated else "(?!)"

    def part(m: re.Match) -> str:
        return _escape(m[0], body[m.end() : m.end() + 1], True) if m[0][0] == "\\" else "\\[" if m[0] == "[" else r"&\&"

    return f"[{'^' * negated}{_IN_CLASS.sub(part, body)}]"


def to_java(pattern: str) -> str:
    """The dot leaves out \\n (also \\r where the pattern is a literal around ``(.*)`` or ``(.*?)``); ^ and $ are the ends of the text."""
    plain = {".": r"[^\n\r]" if _SHAPE.match(pattern) else r"[^\n]", "^": r"\A", "$": r"\z"}

    def part(m: re.Match) -> str:
        if m[0] == "\\" or (m["class"] and not m["end"]) or (m["mark"] and m["mark"] not in ("?:", "?=", "?!")):
            raise ConfigError(f"invalid pattern: {pattern}")
        if m["escape"]:
            return _escape(m[0], pattern[m.end() : m.end() + 1], False)
        return _class(bool(m["not"]), m["body"]) if m["class"] else plain.get(m[0], m[0])

    return _PART.sub(part, pattern)


def compiled(pattern: str) -> str:
    """The Java form; ConfigError if it is no pattern."""
    java = to_java(pattern)
    session = SparkSession.getActiveSession()
    try:
        if session is not None and hasattr(session, "_jvm"):
            session._jvm.java.util.regex.Pattern.compile(java)
        else:
            re.compile(pattern)
    except Exception as e:
        raise ConfigError(f"invalid pattern: {pattern}: {str(e).splitlines()[0]}") from e
    return java


def find_all(c: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping: the first group where there is one ("" if it took no part), else the whole."""
    return F.regexp_extract_all(c, F.lit(compiled(pattern)), F.lit(1 if groups(pattern) else 0))


def substitute(c: Column, pattern: str, new: str) -> Column:
    """All matches replaced; ``$&`` is the match, ``$1`` a group, ``$$`` a dollar."""
    count = groups(pattern)

    def part(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] == "$&":
            return "$0"
        if m[1]:
            n = int(m[1])
            return f"${n}" if 0 < n <= count else ""
        return "\\" + m[0]

    return F.regexp_replace(c, compiled(pattern), re.sub(r"\$\$|\$&|\$([0-9]{1,2})|[\\$]", part, new))

"""The selector subset: tag, .class, #id, [attribute] and [attribute=value], of a compound selector the last part alone.

Of the attributes ``id`` and ``class``, brackets see only a second occurrence in a tag, as the first goes to # and dot tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BLANKS = " \t\n\r\f\v"
_NAME = re.compile(r"[a-zA-Z0-9\-_*:|]*")
_ATTRIBUTE = re.compile(
    rf"""[{BLANKS}]*+(?![>/]|\Z)([^{BLANKS}=>/]*+)[{BLANKS}]*+(?:=[{BLANKS}]*+(?:"([^"]*+)"?|'([^']*+)'?|([^{BLANKS}>]*+)))?"""
)
_TAG_NAME = re.compile(r"<[A-Za-z0-9_:\-]*")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_ASCII_LOWER)


@dataclass(frozen=True)
class Selector:
    tag: str = ""
    id: str = ""
    classes: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str | None], ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.tag or self.id or self.classes or self.attributes)

    @property
    def bare(self) -> bool:
        return not (self.id or self.classes or self.attributes)


def _last_part(text: str) -> str:
    start, depth, quote = 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif depth and c in "\"'":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth = max(0, depth - 1)
        elif not depth and c in BLANKS + ">+~":
            start = i + 1
    return text[start:].rstrip(BLANKS + ">+~")


def _bracket(body: str) -> tuple[str, str | None]:
    name, eq, value = body.strip(BLANKS).partition("=")
    if not eq:
        return lower(name), None
    value = value.strip(BLANKS)
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return lower(name.rstrip(BLANKS)), value


def parse(text: str) -> Selector:
    part = _last_part(text)
    m = _NAME.match(part)
    tag, at = ("" if m[0].startswith("*") else lower(m[0])), m.end()
    own_id, classes, attributes = "", [], []
    while at < len(part):
        c = part[at]
        at += 1
        if c in "#.":
            m = _NAME.match(part, at)
            at = m.end()
            if c == "#":
                own_id = m[0]
            elif m[0]:
                classes.append(m[0])
        elif c == "[":
            end = re.compile(r"""(?:[^\]"']|"[^"]*"|'[^']*')*\]""").match(part, at)
            if not end:
                break
            name, value = _bracket(part[at : end.end() - 1])
            if name:
                attributes.append((name, value))
            at = end.end()
    return Selector(tag, own_id, tuple(classes), tuple(attributes))


def attributes(open_tag: str) -> list[tuple[str, str]]:
    """(lower-cased name, raw value) in order; a value that is missing is empty."""
    out, at = [], _TAG_NAME.match(open_tag).end()
    while m := _ATTRIBUTE.match(open_tag, at):
        out.append((lower(m[1]), m[2] or m[3] or m[4] or ""))
        at = m.end()
    return out


def needles(s: Selector) -> list[str]:
    """Texts that the open tag of any match holds: a cheap test before its attributes are lexed."""
    return [x for x in (s.id, *s.classes, *(v for _, v in s.attributes if v)) if x]


def matches(s: Selector, tag: str, attrs: list[tuple[str, str]]) -> bool:
    if s.tag and s.tag != tag:
        return False
    if s.bare:
        return True
    first: dict[str, str] = {}
    others: list[tuple[str, str]] = []
    for name, value in attrs:
        if name in ("id", "class") and name not in first:
            first[name] = value
        else:
            others.append((name, value))
    if s.id and first.get("id") != s.id:
        return False
    if s.classes and not set(s.classes) <= set(re.split(f"[{BLANKS}]+", first.get("class", ""))):
        return False
    for name, value in s.attributes:
        seen = [v for n, v in others if n == name]
        if not seen or (value is not None and any(v != value for v in seen)):
            return False
    return True

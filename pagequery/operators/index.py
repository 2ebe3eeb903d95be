"""The element index: one pass over a page finds every element, in the order in which elements close.

Offsets are code points. The pass is driven by one regular expression, which jumps from tag to tag; selectors are pushed down
into it, so only elements that some query asks for leave Python, with just the attributes and HTML that the queries' fields use.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .selector import Selector, attributes, lower, matches, needles

# Element names with their closing rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = HEADINGS | frozenset("p div ul ol dl table section article aside header hgroup footer nav pre blockquote form fieldset address hr main figure figcaption details summary".split())
_SECTIONS = frozenset("thead tbody tfoot tr td th".split())
CLOSES = {
    "li": frozenset(("li", "dt", "dd")), "dt": frozenset(("dt", "dd", "li")), "dd": frozenset(("dt", "dd", "li")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "tr": frozenset(("tr", "td", "th")), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup")), "thead": _SECTIONS, "tbody": _SECTIONS, "tfoot": _SECTIONS,
} | dict.fromkeys(HEADINGS, HEADINGS)

_NAME = r"[A-Za-z][A-Za-z0-9_:\-]*+"
_REST = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
#: A plain close tag (name); a whole open tag (name, rest), with the place of its close tag if text alone lies between; else the start of another construct: close tag (name), comment, CDATA, declaration, unfinished open tag.
_TOKEN = re.compile(rf"<(?:/({_NAME})>|({_NAME})({_REST[:-1]})>(?:[^<]*+()</\2>)?|/({_NAME})|(!--)|(!\[CDATA\[)|([!?])|([A-Za-z]))")
_TAG_END = re.compile(_REST)
_ANY_TAG = re.compile(r"<[A-Za-z]")
_RAW_CLOSE = {name: re.compile(f"</{name}", re.I | re.A) for name in ("script", "style")}
_BLANKS = " \t\n\r\f\v"


class Element(NamedTuple):
    tag: str
    open: int
    open_gt: int
    close: int
    end: int
    seq: int

    @property
    def inner(self) -> int:
        return self.open_gt + 1


def _skip(html: str, what: str, at: int) -> int:
    found = html.find(what, at)
    return len(html) if found < 0 else found + len(what)


_NAMES: dict[str, str] = {}


def _lowered(name: str) -> str:
    if len(_NAMES) > 4096:
        _NAMES.clear()
    return _NAMES.setdefault(name, lower(name))


def elements(html: str, tags: frozenset[str] | None = None) -> list[Element]:
    """All elements in the order in which they close, or only those with the given tags; seq counts all."""
    out: list[Element] = []
    stack: list[tuple[str, int, int]] = []
    n, at, seq = len(html), 0, 0
    names, void, raw = _NAMES, VOID, _RAW_CLOSE

    def emit(tag: str, start: int, gt: int, close: int, end: int) -> None:
        nonlocal seq
        if tags is None or tag in tags:
            out.append(Element(tag, start, gt, close, end, seq))
        seq += 1

    def close(tag: str, start: int, end: int) -> None:
        """Ends the innermost open element of that name and all inside it; nothing if there is none."""
        depth = len(stack) - 1
        while depth >= 0 and stack[depth][0] != tag:
            depth -= 1
        if depth >= 0:
            while len(stack) > depth + 1:
                emit(*stack.pop(), start, start)
            emit(*stack.pop(), start, end)

    running = True
    while running:
        running = False
        for m in _TOKEN.finditer(html, at):
            kind = m.lastindex
            if kind == 1:
                start, after = m.span()
                close(names.get(m[1]) or _lowered(m[1]), start, after)
            elif kind == 3 or kind == 4:
                name, rest = m.group(2, 3)
                tag = names.get(name) or _lowered(name)
                start, after = m.start(), m.end(3) + 1
                alone = rest and rest[-1] in "/ \t\n\r\f\v" and rest.rstrip(_BLANKS).endswith("/")
                if alone or tag in void:
                    emit(tag, start, after - 1, after, after)
                    if kind == 4:  # what follows is none of its business
                        at, running = after, True
                        break
                elif tag in raw:
                    found = raw[tag].search(html, after)
                    if not found:
                        emit(tag, start, after - 1, n, n)
                        break
                    tail = _TAG_END.match(html, found.end())
                    at = tail.end() if tail else n
                    emit(tag, start, after - 1, found.start(), at)
                    running = True
                    break
                else:
                    if stack:
                        closes = CLOSES.get(tag, ())
                        while stack and (stack[-1][0] in closes or (stack[-1][0] == "p" and tag in ENDS_PARAGRAPH)):
                            emit(*stack.pop(), start, start)
                    if kind == 4:
                        emit(tag, start, after - 1, m.start(4), m.end())
                    else:
                        stack.append((tag, start, after - 1))
            elif kind == 5:
                tag = names.get(m[5]) or _lowered(m[5])
                start, after = m.span()
                if any(s[0] == tag for s in stack):
                    tail = _TAG_END.match(html, after)
                    at = tail.end() if tail else n
                else:
                    at = _skip(html, ">", after)
                close(tag, start, at)
                running = True
                break
            elif kind == 9:  # an open tag without an end stops the scan
                break
            else:
                at = _skip(html, {6: "-->", 7: "]]>", 8: ">"}[kind], m.end())
                running = True
                break
    while stack:
        emit(*stack.pop(), n, n)
    return out


def attribute(html: str, name: str) -> str | None:
    """The raw value in the element's own tag, or in the first tag below that has it; close tags and declarations are passed over."""
    at = 0
    while m := _ANY_TAG.search(html, at):
        end = _TAG_END.match(html, m.start() + 1)
        if not end:
            return None
        tag = html[m.start() : end.end()]
        if name in tag or name in lower(tag):
            for n, v in attributes(tag):
                if n == name:
                    return v
        at = end.end()
    return None


@dataclass(frozen=True)
class Wanted:
    """What one selector query needs of each of its elements."""

    selector: Selector
    multiple: bool
    html: bool
    attributes: tuple[str, ...]

    def columns(self) -> list[str]:
        return ["html"] * self.html + [f"a{i}" for i in range(len(self.attributes))] + ["seq"]

    def arrow(self, found: list[list[tuple]]) -> pa.ListArray:
        """The rows found on each page, column by column."""
        flat = [row for rows in found for row in rows]
        cols = list(zip(*flat, strict=True)) if flat else [()] * len(self.columns())
        arrays = [pa.array(c, pa.int32() if n == "seq" else pa.string()) for n, c in zip(self.columns(), cols, strict=True)]
        ends = [0]
        for rows in found:
            ends.append(ends[-1] + len(rows))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, self.columns()))

    def ddl(self) -> str:
        return f"array<struct<{', '.join(['html: string'] * self.html + [f'a{i}: string' for i in range(len(self.attributes))] + ['seq: int'])}>>"


def select(html: str | None, wanted: list[Wanted]) -> list[list[tuple]]:
    """For each query its elements as rows of its columns, in close order. A null page has none."""
    out: list[list[tuple]] = [[] for _ in wanted]
    live = [k for k, w in enumerate(wanted) if not w.selector.empty]
    if not html or not live:
        return out
    hints = [needles(w.selector) for w in wanted]
    by_tag: dict[str, list[int]] = {}
    anywhere = [k for k in live if not wanted[k].selector.tag]
    for k in live:
        if wanted[k].selector.tag:
            by_tag.setdefault(wanted[k].selector.tag, []).append(k)
    for e in elements(html, None if anywhere else frozenset(by_tag)):
        asked = by_tag.get(e.tag, ()) if not anywhere else sorted([*by_tag.get(e.tag, ()), *anywhere])
        attrs = None
        for k in asked:
            w = wanted[k]
            if not w.multiple and out[k]:
                continue
            if not w.selector.bare:
                if not all(html.find(x, e.open, e.open_gt) >= 0 for x in hints[k]):
                    continue
                attrs = attributes(html[e.open : e.open_gt + 1]) if attrs is None else attrs
                if not matches(w.selector, e.tag, attrs):
                    continue
            span = html[e.open : e.end] if w.html or w.attributes else ""
            out[k].append((*([span] if w.html else ()), *[attribute(span, name) for name in w.attributes], e.seq))
    return out


def index_pages(pages: DataFrame, html: str, wanted: list[Wanted], keep_html: bool = False) -> DataFrame:
    """pages without the html (but with keep_html), with a column ``_q0``, ``_q1``, ... of element lists for each query: pages never shuffle."""
    keep = [c for c in pages.columns if keep_html or c != html]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [select(x, wanted) for x in b.column(b.schema.get_field_index(html)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [w.arrow([f[k] for f in found]) for k, w in enumerate(wanted)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[f"_q{k}" for k in range(len(wanted))]])

    ddl = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + [f"_q{k} {w.ddl()}" for k, w in enumerate(wanted)]
    return pages.mapInArrow(run, ", ".join(ddl))

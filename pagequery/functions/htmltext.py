"""The text of an HTML fragment, in one pattern pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import decode_leaf
from .let import let

_BODY = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
_NAME = r"[A-Za-z][A-Za-z0-9_:-]*+"
_BLANK = r"[ \t\n\r\f\x0B]"
#: Runs of white space but for one plain space.
_BLANKS = rf" {_BLANK}++|[\t\n\r\f\x0B]{_BLANK}*+"
#: Marks where markup stood, so that a reference never closes over it; and an ampersand inside CDATA, which is no reference.
_CUT, _AMP = "", ""
_MARKUP = (
    rf"<(?:(?:/|(?!(?i:script|style)(?![A-Za-z0-9_:-]))){_NAME}{_BODY}"  # first what is most frequent
    r"|!--[\s\S]*?(?:-->|\z)"
    r"|!\[CDATA\[([\s\S]*?)(?:\]\]>|\z)"
    r"|[!?][^>]*+(?:>|\z)"
    rf"|(?i:(script|style))(?![A-Za-z0-9_:-]){_BODY}(?<!/{_BLANK}{{0,64}}>)(?:[\s\S]*?(?i:</\2)(?:{_BODY}|[\s\S]*+)|[\s\S]*+)"
    rf"|/?{_NAME}{_BODY}"
    r"|/?[A-Za-z][\s\S]*+)"
)


def _guard_cdata(c: Column) -> Column:
    def piece(p: Column, i: Column) -> Column:
        inside = F.substring_index(p, "]]>", 1)
        return F.when(i == 0, p).otherwise(F.concat(F.replace(inside, F.lit("&"), F.lit(_AMP)), F.substring(p, F.char_length(inside) + 1, F.char_length(p))))

    return F.when(c.contains("<![CDATA["), F.array_join(F.transform(F.split(c, r"<!\[CDATA\[", -1), piece), "<![CDATA[")).otherwise(c)


def html_text(c: Column) -> Column:
    """Tags, comments, declarations, scripts and styles go, CDATA stays, references decode, white space collapses. Tags leave no space."""


    def full(v: Column) -> Column:
        cut = F.regexp_replace(_guard_cdata(v), _MARKUP, f"$1{_CUT}")
        text = F.replace(F.replace(decode_leaf(cut), F.lit(_CUT), F.lit("")), F.lit(_AMP), F.lit("&"))
        return F.btrim(F.regexp_replace(text, _BLANKS, " "), F.lit(" "))

    def simple(v: Column) -> Column:
        """Without markup and runs of white space, a single inner line break or tab stays."""
        return let(F.btrim(v, F.lit(" \t\n\r\f\x0b")), lambda t: F.when(~t.rlike(f"{_BLANK}{_BLANK}"), t))

    return let(c, lambda v: F.coalesce(F.when(~(v.contains("<") | v.contains("&")), simple(v)), full(v)))

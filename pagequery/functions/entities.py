"""Character references. Two decoders with different tables: one for text and attribute leaves, one for the cleaning stage."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

#: The leaf table: all HTML 4 names and apos, but for two names that its lookup cannot reach and one without a valid value.
LEAF = {k: chr(v) for k, v in name2codepoint.items() if k not in ("sup2", "supe")} | {"apos": "'", "chi": ""}

# The names that the cleaning stage knows.
_CLEAN_NAMES = "amp lt gt quot apos nbsp copy reg deg mdash ndash hellip laquo raquo euro pound yen cent trade middot bull lsquo rsquo ldquo rdquo times divide plusmn frac12 frac14 frac34 sect para micro iexcl iquest szlig egrave eacute agrave aacute ccedil ntilde uuml ouml auml Uuml Ouml Auml"
CLEAN = {k: "'" if k == "apos" else chr(name2codepoint[k]) for k in _CLEAN_NAMES.split()}

#: Numeric references that browsers read as Windows-1252.
CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,string>")


def _by_letter(pairs: dict) -> Callable[[Column], Column]:
    """Looks a name up (null: unknown) in a map for each first letter, as Spark searches a map from its start."""
    first, last = ord("A"), ord("z")
    tables = F.array(*[_table({k: v for k, v in pairs.items() if ord(k[0]) == c}) for c in range(first, last + 1)])
    return lambda name: F.try_element_at(F.get(tables, F.ascii(name) - first), name)


def char(cp: Column) -> Column:
    """The character of a valid code point."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _code_point(ref: Column) -> Column:
    """Of ``#123`` or ``#x1F``; more than eight digits count as beyond Unicode."""
    body = F.regexp_replace(ref, "^#[xX]?0*", "")
    is_hex = ref.rlike("^#[xX]")
    value = F.when(is_hex, F.conv(F.concat(F.lit("0"), body), 16, 10)).otherwise(F.concat(F.lit("0"), body)).cast("long")
    return F.when(F.char_length(body) > 8, F.lit(0x110000)).otherwise(value)


_NUMERIC = r"\A#(?:[0-9]+|[xX][0-9a-fA-F]+)\z"


def _decode(c: Column, value) -> Column:
    """c with each reference replaced by value(reference), kept where that is null; one pass, so nothing decodes twice."""

    def piece(p: Column, i: Column) -> Column:
        # what stands before the first semicolon; names need no pattern, as the table holds names alone
        ref = F.substring_index(p, ";", 1)
        rest = F.substring(p, F.char_length(ref) + 2, F.char_length(p))
        known = F.when((ref != p) & (~ref.startswith("#") | ref.rlike(_NUMERIC)), let(ref, value))
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(known, rest), F.concat(F.lit("&"), p)))

    return let(c, lambda v: F.when(v.contains("&"), F.array_join(F.transform(F.split(v, "&", -1), piece), "")).otherwise(v))


def decode_leaf(c: Column) -> Column:
    known, fixes = _by_letter(LEAF), _table(CP1252)

    def value(ref: Column) -> Column:
        cp = _code_point(ref)
        bad = (cp == 0) | (cp > 0x10FFFF) | cp.between(0xD800, 0xDFFF)
        number = F.when(bad, F.lit("�")).when(cp.between(0x80, 0x9F), F.coalesce(F.try_element_at(fixes, cp.cast("int")), char(cp))).otherwise(char(cp))
        return F.when(ref.startswith("#"), number).otherwise(F.when(F.char_length(ref) <= 33, known(ref)))

    return _decode(c, value)


def decode_clean(c: Column) -> Column:
    """References of at most nine characters; surrogates vanish, as their bytes are no character."""
    known = _by_letter(CLEAN)

    def value(ref: Column) -> Column:
        cp = _code_point(ref)
        number = F.when((cp > 0) & (cp <= 0x10FFFF), F.when(cp.between(0xD800, 0xDFFF), F.lit("")).otherwise(char(cp)))
        return F.when(F.char_length(ref) <= 9, F.when(ref.startswith("#"), number).otherwise(known(ref)))

    return _decode(c, value)

"""The cleaning sieve: entities, invisibles, whitespace, fold, numeric, and null tokens at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ENTITIES, FOLD, INVISIBLES, NULL_TOKENS, NUMERIC, WHITESPACE
from .entities import decode_clean
from .let import let

# Character classes, folds, currency signs and tokens.
ASCII_BLANK = r"[ \t\n\r\f\x0B]"
_SPACE = r" \t\n\r\f\x0B\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Runs of white space but for one plain space, which stays what it is. What && stands before is a quick test that letters fail.
_SPACES = rf" [{_SPACE}]++|[\x00-\x1F\x{{80}}-\x{{3000}}&&[{_SPACE}]][{_SPACE}]*+"
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_UNSEEN = r"[\x{80}-\x{FEFF}&&[\x{80}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]]"
_PLAIN = r"^[a-zA-Z0-9 \t\n\r\f\x0B!@#%^*()\-_=+\[\]{}|;:,.<>?/'\"\\`~]*+$"
_FOLDED = "‘’′“”″–—‒―«»‹›"
_FOLDS = "'''\"\"\"----\"\"''"
_CURRENCY = "$£¥¢€₹₽₩฿"
TOKENS = ("", "null", "none", "n/a", "na", "nil", "unknown", "-", "--")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_NUMBER = rf"^(?:[ \t\n\r\f\x0B{_CURRENCY}]|[-+](?=[\s\S]))*+([0-9]{{1,3}}(?:,[0-9]{{3}})++|[0-9]++)(?:\.([0-9]*+))?+[ \t\n\r\f\x0B{_CURRENCY}]*+%?+[ \t\n\r\f\x0B{_CURRENCY}]*+\z"


def whitespace(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, _SPACES, " "), F.lit(" "))


def invisibles(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _CONTROLS, ""), _UNSEEN, "")


def fold(c: Column) -> Column:
    return F.replace(F.translate(c, _FOLDED, _FOLDS), F.lit("…"), F.lit("..."))


def canonical_number(c: Column) -> Column:
    """The canonical form of a decorated number, null for what is none. Of several signs the last counts."""
    whole = F.replace(F.regexp_extract(c, _NUMBER, 1), F.lit(","), F.lit(""))
    part = F.regexp_extract(c, _NUMBER, 2)
    signs = F.regexp_replace(F.regexp_extract(c, r"^([^0-9]*+)", 1), "[^-+]", "")
    made = F.concat(F.when(signs.endswith("-"), "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(c.rlike(_NUMBER), made)  # a match makes all parts non-null


def numeric(c: Column) -> Column:
    return let(c, lambda v: F.coalesce(canonical_number(v), v))


def default_sieve(c: Column) -> Column:
    """Entities, invisibles and whitespace in one: characters from references are cleaned too, but controls among them stay."""

    def mixed(v: Column) -> Column:
        return F.regexp_replace(decode_clean(F.regexp_replace(v, _CONTROLS, "")), _UNSEEN, "")

    return whitespace(let(c, lambda v: F.when(v.rlike(_PLAIN), v).otherwise(mixed(v))))


def sieve(c: Column, mask: int) -> Column:
    """All stages of the mask but null tokens."""
    text = ENTITIES | INVISIBLES | WHITESPACE
    if mask & text == text:
        c = default_sieve(c)
    else:
        for bit, stage in ((ENTITIES, decode_clean), (INVISIBLES, invisibles), (WHITESPACE, whitespace)):
            c = stage(c) if mask & bit else c
    c = fold(c) if mask & FOLD else c
    return numeric(c) if mask & NUMERIC else c


def is_null_token(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER).isin(*TOKENS) | (c == "—")


def nulls(c: Column, mask: int) -> Column:
    return let(c, lambda v: F.when(~is_null_token(v), v)) if mask & NULL_TOKENS else c

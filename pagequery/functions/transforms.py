"""Transforms, left to right; a last ``int`` or ``float`` sets the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Rule
from .let import let
from .regex import substitute
from .sieve import LOWER, UPPER, canonical_number

_BLANK = r"[ \t\n\r\f\x0B]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def lowercase(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def uppercase(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def _leading_int(c: Column) -> Column:
    return F.regexp_extract(c, rf"\A{_BLANK}*([+-]?[0-9]+)", 1).try_cast("long")


def to_int(c: Column) -> Column:
    """The whole number that c begins with; of a decorated number its whole part; else null."""
    return let(c, lambda v: F.coalesce(_leading_int(v), _leading_int(canonical_number(v))))


def _leading_float(c: Column) -> Column:
    digits = F.regexp_extract(c, rf"\A{_BLANK}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    word = F.lower(F.regexp_extract(c, rf"(?i)\A{_BLANK}*([+-]?(?:inf|nan))", 1))
    base16 = F.regexp_extract(c, rf"\A{_BLANK}*([+-]?)0[xX]([0-9a-fA-F]+)", 2)
    number = digits.try_cast("double")
    number = F.when(~F.abs(number).isin(float("inf")), number)
    sign = F.when(c.rlike(rf"\A{_BLANK}*-"), -1.0).otherwise(1.0)
    special = F.when(word.endswith("inf"), F.lit(float("inf")) * sign).when(word.endswith("nan"), F.lit(float("nan")))
    return F.when(word != "", special).when(base16 != "", F.conv(base16, 16, 10).cast("double") * sign).otherwise(number)


def to_float(c: Column) -> Column:
    return let(c, lambda v: F.coalesce(_leading_float(v), let(canonical_number(v), _leading_float)))


def six_decimals(x: Column) -> Column:
    """As C prints a double by default."""
    return let(x, _print)


def _print(x: Column) -> Column:
    odd = F.isnan(x) | F.abs(x).isin(float("inf"))
    return F.when(odd, F.lower(F.replace(x.cast("string"), F.lit("Infinity"), F.lit("inf")))).otherwise(F.replace(F.call_function("format_number", x, F.lit("0.000000")), F.lit(","), F.lit("")))


def url_join(base: Column, rel: Column) -> Column:
    """Dot segments stay; spaces of a document-relative reference become %20."""
    return let(rel, lambda v: _joined(base, v))


def _joined(base: Column, rel: Column) -> Column:
    scheme = F.substring_index(base, "://", 1)
    rest = F.substring(base, F.instr(base, "://") + 3, F.char_length(base))
    host = F.substring_index(rest, "/", 1)
    path = F.when(F.instr(rest, "/") > 0, F.substring(rest, F.char_length(host) + 1, F.char_length(rest))).otherwise("/")
    path = F.regexp_extract(path, r"\A([^?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"\A([\s\S]*/)", 1)
    return (
        F.when(rel == "", base).when((base == "") | base.isNull(), rel).when(rel.contains("://"), rel)
        .when(rel.startswith("mailto:") | rel.startswith("tel:") | rel.startswith("data:") | rel.startswith("javascript:"), rel)
        .when(~base.contains("://"), rel)
        .when(rel.startswith("//"), F.concat(scheme, F.lit(":"), rel))
        .when(rel.startswith("/"), F.concat(root, rel))
        .when(rel.startswith("?") | rel.startswith("#"), F.concat(root, path, rel))
        .otherwise(F.concat(root, folder, F.replace(rel, F.lit(" "), F.lit("%20"))))
    )


def value_type(rule: Rule) -> str:
    last = rule.transform[-1] if rule.transform else ""
    return {"int": "bigint", "float": "double"}.get(last, "string")


def step(value: Column, rule: Rule, k: int, base: Column) -> Column:
    """The rule's k-th transform of a value that isn't null."""
    what, last = rule.transform[k], k == len(rule.transform) - 1
    if what in ("trim", "lowercase", "uppercase"):
        return {"trim": trim, "lowercase": lowercase, "uppercase": uppercase}[what](value)
    if what == "urljoin":
        return url_join(base, value)
    if what == "int":
        return to_int(value) if last else F.coalesce(to_int(value).cast("string"), F.lit(""))
    if what == "float":
        text = six_decimals(to_float(value))
        return text.cast("double") if last else F.coalesce(text, F.lit(""))
    return substitute(value, rule.regex or "", rule.regex_sub) if what == "regex_sub" and rule.regex_sub is not None else value


def apply(c: Column, rule: Rule, base: Column) -> Column:
    """One cleaned value through the rule's transforms; null stays null."""

    def all_steps(v: Column) -> Column:
        value = v
        for k in range(len(rule.transform)):
            value = step(value, rule, k, base)
        return F.when(v.isNotNull(), value).cast(value_type(rule))

    return let(c, all_steps).cast(value_type(rule)) if rule.transform else c

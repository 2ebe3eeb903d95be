"""Aggregates over a list of values: of one element (raw_count given), or of all elements of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Rule
from .transforms import value_type


def result_type(rule: Rule) -> str:
    kind = value_type(rule)
    return {"count": "bigint", "exists": "boolean", "first": kind, "last": kind, "join": "string"}.get(rule.aggregate, f"array<{kind}>")


def json_number(x: Column) -> Column:
    """A double as JSON text: whole numbers below 1e15 with one decimal (and -0.0 with its sign), others to 15 significant digits, null for what is not finite; no value for no value."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    exponent = F.floor(F.log10(F.abs(x))).cast("int")
    fixed = F.regexp_replace(F.format_string("%.15f", x), r"0+$", "")
    short = F.regexp_replace(F.format_string("%.14e", x), r"\.?0*e", "e")
    text = F.when(whole, F.format_string("%.1f", x)).when(exponent.between(-5, 14), F.rtrim(F.regexp_replace(F.round(x.cast("decimal(38,18)"), 15).cast("string"), r"0+$", ""))).otherwise(short)
    return F.when(x.isNotNull(), F.when(F.isnan(x) | F.abs(x).isin(float("inf")), "null").otherwise(F.coalesce(text, fixed)))


def as_text(values: Column, kind: str) -> Column:
    """Values as they are joined: numbers as JSON, nulls as null."""
    one = (lambda x: json_number(x)) if kind == "double" else (lambda x: x.cast("string"))
    return F.transform(values, lambda x: F.coalesce(one(x), F.lit("null")))


def over_values(values: Column, rule: Rule, raw_count: Column) -> Column:
    """The rule's aggregate of one element's values."""
    kind, agg = value_type(rule), rule.aggregate
    if agg == "count":
        return raw_count.cast("bigint")
    if agg == "exists":
        return raw_count > 0
    if agg == "first":
        return F.get(values, F.lit(0))
    if agg == "last":
        return F.when(F.size(values) > 0, F.element_at(values, -1))
    if agg == "unique":
        return F.array_distinct(values)
    if agg == "join":
        return F.array_join(as_text(values, kind), rule.join_sep or "")
    return values


def over_elements(each: Column, rule: Rule) -> Column:
    """The same aggregate once more, over the results of all elements (each: an array of result_type(rule))."""
    kind, agg = value_type(rule), rule.aggregate
    if agg == "count":
        return F.size(each).cast("bigint")
    if agg == "exists":
        if rule.leaf is None and not rule.transform:
            return F.size(each) > 0
        return F.exists(each, lambda x: F.coalesce(x, F.lit(False)))
    if agg in ("first", "last", "join"):
        whole = F.array_join(F.transform(each, lambda x: F.coalesce(x, F.lit("null"))), rule.join_sep or "") if agg == "join" else None
        return {"first": F.get(each, F.lit(0)), "last": F.when(F.size(each) > 0, F.element_at(each, -1)), "join": whole}[agg]
    flat = F.flatten(F.transform(each, lambda x: F.coalesce(x, F.array(F.lit(None).cast(kind)))))
    return F.array_distinct(flat) if agg == "unique" else flat

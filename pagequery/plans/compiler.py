"""Compiles queries: raw-regex and bulk-text queries are Columns alone; selector queries go over one index pass.

Each query becomes a DataFrame with a schema known before it runs: the page's key columns, ``_pos`` (the record's place on its
page) and the fields in their declared order; a field that bears the name of a key or of ``_pos`` takes its place. Records of a page stay in one
row until they are exploded, so no query shuffles. A field's value is made in successive projections (raw, cleaned, each transform), so every step is a real
column and stays in generated code; only lists go through lambdas.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CLEAN, Config, Field, Query, Rule
from ..functions import aggregates
from ..functions.entities import decode_leaf
from ..functions.htmltext import html_text
from ..functions.let import let, named
from ..functions.regex import compiled, find_all, groups
from ..functions.sieve import nulls, sieve
from ..functions.transforms import apply, step, value_type
from ..operators.index import Wanted, index_pages
from ..operators.selector import lower, parse

_NONE = "array<string>"


@dataclass(frozen=True)
class Source:
    """Column names of the input: the payload, the page's url, and what travels along; and the name of a record's place."""

    html: str = "html"
    url: str | None = "url"
    keys: tuple[str, ...] = ("page_id",)
    pos: str = "_pos"

    def rows(self, pages: DataFrame) -> DataFrame:
        """pages under names that no field has: __k0, __k1, ..., __url, __html."""
        url = F.coalesce(F.col(f"`{self.url}`"), F.lit("")) if self.url else F.lit("")
        return pages.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)], url.alias("__url"), F.col(f"`{self.html}`").alias("__html"))

    def inner(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.keys))]

    def result(self, rows: DataFrame, fields: list[Column], names: list[str], more: tuple[str, ...] = ()) -> DataFrame:
        """Keys, more columns, __pos and fields under their own names; a field's name wins."""
        own = {**{k: F.col(f"__k{i}") for i, k in enumerate(self.keys)}, **{m: F.col(m) for m in more}, self.pos: F.col("__pos")}
        return rows.select(*[c.alias(n) for n, c in own.items() if n not in names], *[c.alias(n) for c, n in zip(fields, names, strict=True)])


def fields_of(query: Query) -> list[Field]:
    """A name that is declared twice keeps its first place and its last rule."""
    return list({f.name: f for f in query.extract}.values())


def schema_of(query: Query) -> dict[str, str]:
    return {f.name: aggregates.result_type(f.rule) for f in fields_of(query)}


def _mask(rule: Rule, inherited: int) -> int:
    return inherited if rule.clean is None else rule.clean


def _finish(raw: Column | None, single: Column | None, rule: Rule, base: Column, mask: int, raw_count: Column | None = None) -> Column:
    """Raw values (a list, or one value that is null if missing) -> the field's value."""

    def clean(v: Column) -> Column:
        return apply(nulls(sieve(v, mask), mask), rule, base)

    kind = value_type(rule)
    if single is not None:

        def one(v: Column) -> Column:
            values = F.array(clean(v))
            return aggregates.over_values(values, rule, F.lit(1) if raw_count is None else raw_count)

        empty = F.lit(None) if rule.optional else aggregates.over_values(F.array().cast(f"array<{kind}>"), rule, F.lit(0))
        result = let(single, lambda v: F.when(v.isNotNull(), one(v)).otherwise(empty))
    else:

        def many(v: Column) -> Column:
            value = aggregates.over_values(F.transform(v, clean), rule, F.size(v) if raw_count is None else raw_count)
            return F.when(F.size(v) > 0, value) if rule.optional else value

        result = let(raw, many)
    return result.cast(aggregates.result_type(rule))


def leaf(html: Column | None, attr: Callable[[str], Column], rule: Rule, base: Column, mask: int, is_html: bool = True) -> Column:
    """A field of an element (or of any text): text before attribute before regex; none of them is no value."""
    if rule.leaf == "text":
        return _finish(None, html_text(html) if is_html else html, rule, base, mask)
    if rule.leaf == "attribute":
        return _finish(None, decode_leaf(attr(lower(rule.attribute))), rule, base, mask)
    if rule.leaf == "regex":
        return _finish(find_all(html, rule.regex), None, rule, base, mask)
    return _finish(F.array().cast(_NONE), None, rule, base, mask)


def _attribute_column(html: Column, name: str) -> Column:
    """An attribute of a text that is no indexed element: of the first tag in it that has it."""
    blank = r"[ \t\n\r\f\x0B]"
    name = "".join(f"[{c}{c.upper()}]" if c.isalpha() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in name)
    value = rf"""(?:=(?:{blank}*+(?:"([^"]*+)"?|'([^']*+)'?|([^ \t\n\r\f\x0B>]*+))))?+"""
    other = rf"""(?:[^ \t\n\r\f\x0B=>/]++{blank}*+(?:={blank}*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f\x0B>]*+))?+{blank}*+)*?"""
    pattern = rf"<[A-Za-z][A-Za-z0-9_:-]*+{blank}*+{other}{name}(?=[ \t\n\r\f\x0B=>/]){blank}*+{value}"
    return F.when(html.rlike(pattern), F.concat(*[F.regexp_extract(html, pattern, i) for i in (1, 2, 3)]))


def check(query: Query) -> None:
    """ConfigError for a pattern that is none."""
    for pattern in (query.regex, *[f.rule.regex for f in query.extract]):
        if pattern is not None:
            compiled(pattern)


def wanted_of(query: Query) -> Wanted:
    rules = [f.rule for f in fields_of(query)]
    names = dict.fromkeys(lower(r.attribute) for r in rules if r.leaf == "attribute")
    return Wanted(parse(query.selector), query.multiple, any(r.leaf in ("text", "regex") for r in rules), tuple(names))


def _over(field_of: Callable[[Column, Rule], Column], rule: Rule) -> Callable[[Column], Column]:
    return lambda e: field_of(e, rule)


def _empty(rule: Rule) -> Column:
    kind = value_type(rule)
    return F.lit(None) if rule.optional else aggregates.over_values(F.array().cast(f"array<{kind}>"), rule, F.lit(0))


def finished(rows: DataFrame, jobs: list[tuple[Field, Column | None, int]]) -> tuple[DataFrame, list[Column]]:
    """rows with helper columns, and the value of each field; jobs: the field, its single raw value (None: it is made from lists, elsewhere) and its mask."""
    jobs = [(f, raw, mask, f"__r{i}") for i, (f, raw, mask) in enumerate(jobs)]
    one = [j for j in jobs if j[1] is not None]
    rows = rows.select("*", *[raw.alias(r) for _, raw, _, r in one])
    rows = rows.select("*", *[nulls(sieve(named(r), mask), mask).alias(f"{r}c") for _, _, mask, r in one])
    now = {r: f"{r}c" for _, _, _, r in one}
    for k in range(max((len(f.rule.transform) for f, *_ in one), default=0)):
        more = [(r, step(named(now[r]), f.rule, k, named("__url")).alias(f"{r}t{k}")) for f, _, _, r in one if k < len(f.rule.transform)]
        rows = rows.select("*", *[c for _, c in more])
        now |= {r: f"{r}t{k}" for r, _ in more}
    out = []
    for f, raw, _, r in jobs:
        if raw is None:
            out.append(None)
            continue
        value = F.when(F.col(f"{r}c").isNotNull(), F.col(now[r])).cast(value_type(f.rule)) if f.rule.transform else F.col(now[r])
        whole = F.when(F.col(r).isNotNull(), aggregates.over_values(F.array(value), f.rule, F.lit(1))).otherwise(_empty(f.rule))
        out.append(whole.cast(aggregates.result_type(f.rule)))
    return rows, out


def _raw(html: Column | None, attr: Callable[[str], Column], rule: Rule, is_html: bool) -> Column | None:
    """The single raw value of a text or attribute leaf."""
    if rule.leaf == "text":
        return html_text(html) if is_html else html
    return decode_leaf(attr(lower(rule.attribute))) if rule.leaf == "attribute" else None


def _parts(wanted: Wanted, e: Column) -> tuple[Column | None, Callable[[str], Column]]:
    """An element's HTML and its attributes."""
    return e["html"] if wanted.html else None, lambda name: e[f"a{wanted.attributes.index(name)}"]


def _merged(query: Query, config: Config, wanted: Wanted, elements: Column) -> list[Column]:
    """The fields of the one record that all elements of a page give."""

    def field_of(e: Column, rule: Rule) -> Column:
        return leaf(*_parts(wanted, e), rule, F.col("__url"), _mask(rule, config.clean))

    cols = []
    for f in fields_of(query):
        if f.rule.leaf is None and not f.rule.transform and f.rule.aggregate in ("count", "exists"):
            cols.append(F.size(elements).cast("bigint") if f.rule.aggregate == "count" else F.size(elements) > 0)
        else:
            cols.append(aggregates.over_elements(F.transform(elements, _over(field_of, f.rule)), f.rule))
    return cols


def selector_records(pages: DataFrame, query: Query, config: Config, source: Source) -> DataFrame:
    wanted, fields = wanted_of(query), fields_of(query)
    names = [f.name for f in fields]
    indexed = index_pages(source.rows(pages), "__html", [wanted])
    if query.merged:
        return source.result(indexed.withColumn("__pos", F.lit(0)), _merged(query, config, wanted, F.col("_q0")), names)
    rows = indexed.select(*source.inner(), "__url", F.posexplode("_q0").alias("__pos", "_e"))
    rows = rows.select(*source.inner(), "__url", "__pos", *[F.col(f"_e.{c}").alias(f"__e{c}") for c in wanted.columns()])
    html = named("__ehtml") if wanted.html else None

    def attr(name: str) -> Column:
        return named(f"__ea{wanted.attributes.index(name)}")

    rows, made = finished(rows, [(f, _raw(html, attr, f.rule, True), _mask(f.rule, config.clean)) for f in fields])
    cols = [leaf(html, attr, f.rule, F.col("__url"), _mask(f.rule, config.clean)) if c is None else c for f, c in zip(fields, made, strict=True)]
    return source.result(rows, cols, names)


def _match_raw(m: Column, rule: Rule, is_html: bool) -> Column | None:
    """The single raw value of a field of a whole match; None where the field's own regex looks inside."""
    if rule.regex is not None:
        return None
    return _raw(m, lambda name: _attribute_column(m, name), rule, is_html) if rule.leaf else m


def regex_records(pages: DataFrame, query: Query, config: Config, source: Source, is_html: bool = True) -> DataFrame:
    """One record a match of the whole payload; a field's own regex looks inside the match."""
    fields, m = fields_of(query), named("__m")
    rows = source.rows(pages).select(*source.inner(), "__url", F.posexplode(find_all(F.col("__html"), query.regex)).alias("__pos", "__m"))
    rows, made = finished(rows, [(f, _match_raw(m, f.rule, is_html), _mask(f.rule, config.clean)) for f in fields])
    cols = [_regex_field(m, f.rule, F.col("__url"), _mask(f.rule, config.clean)) if c is None else c for f, c in zip(fields, made, strict=True)]
    return source.result(rows, cols, [f.name for f in fields])


def _regex_field(m: Column, rule: Rule, base: Column, mask: int) -> Column:
    """Without a match the empty list (null where the type is no list); counts and existence see zero raw values."""
    found = find_all(m, rule.regex)
    value = _finish(found, None, rule, base, mask, raw_count=F.lit(0))
    listed = aggregates.result_type(rule).startswith("array")
    return value if listed else F.when(F.size(found) > 0, value)


def scalar_record(rows: DataFrame, query: Query, source: Source, is_html: bool = True) -> DataFrame:
    """Every payload as one element, under the default sieve and without a base url: one record a row."""
    html, fields = F.col("__html"), fields_of(query)
    cols = [leaf(html, lambda name: _attribute_column(html, name), f.rule, F.lit(""), _mask(f.rule, DEFAULT_CLEAN), is_html) for f in fields]
    found = source.result(source.rows(rows).withColumn("__pos", F.lit(0)), cols, [f.name for f in fields])
    return found if source.pos in [f.name for f in fields] else found.drop(source.pos)


def compile_query(query: Query, config: Config, pages: DataFrame, source: Source, is_html: bool = True) -> DataFrame:
    """The records of one query; its plan indexes the pages for it alone. XPath queries, and selector queries over plain text, have none."""
    check(query)
    if query.kind == "regex":
        return regex_records(pages, query, config, source, is_html)
    if query.kind == "selector" and is_html:
        return selector_records(pages, query, config, source)
    types = schema_of(query)
    return source.result(source.rows(pages).withColumn("__pos", F.lit(0)), [F.lit(None).cast(t) for t in types.values()], list(types)).limit(0)


def compile_config(config: Config, pages: DataFrame, source: Source, is_html: bool = True) -> dict[str, DataFrame]:
    """Query name -> records."""
    return {q.name: compile_query(q, config, pages, source, is_html) for q in config.queries}


def _record_of(number: int, query: Query, kinds: dict[str, set[str]], types: dict[str, str]) -> Callable[[Column, list[Column]], Column]:
    """A record of the query as a structure that has the fields of all queries."""

    def record(pos: Column, values: list[Column]) -> Column:
        own = {f.name: F.to_json(F.struct(v.alias("v"))) if len(kinds[f.name]) > 1 else v for f, v in zip(fields_of(query), values, strict=True)}
        cols = [own.get(name, F.lit(None)).cast(kind).alias(f"f{i}") for i, (name, kind) in enumerate(types.items())]
        return F.struct(F.lit(number).alias("_query"), F.lit(query.name).alias("_name"), pos.alias("__pos"), *cols)

    return record


def _of_match(query: Query, config: Config, is_html: bool, record: Callable) -> Callable[[Column, Column], Column]:
    def value(m: Column, rule: Rule) -> Column:
        mask, raw = _mask(rule, config.clean), _match_raw(m, rule, is_html)
        return _regex_field(m, rule, F.col("__url"), mask) if raw is None else _finish(None, raw, rule, F.col("__url"), mask)

    return lambda m, i: record(i, [value(m, f.rule) for f in fields_of(query)])


def _of_element(query: Query, config: Config, wanted: Wanted, record: Callable) -> Callable[[Column, Column], Column]:
    return lambda e, i: record(i, [leaf(*_parts(wanted, e), f.rule, F.col("__url"), _mask(f.rule, config.clean)) for f in fields_of(query)])


def combined(config: Config, pages: DataFrame, source: Source, is_html: bool = True) -> DataFrame:
    """All queries' records in one pass over the pages: keys, _query (its number), _name, the place and the union of all fields, as JSON where types differ."""
    for q in config.queries:
        check(q)
    kinds: dict[str, set[str]] = {}
    for q in config.queries:
        for name, kind in schema_of(q).items():
            kinds.setdefault(name, set()).add(kind)
    types = {name: k.copy().pop() if len(k) == 1 else "string" for name, k in kinds.items()}
    chosen = [q for q in config.queries if q.kind == "selector"] if is_html else []
    wanted = [wanted_of(q) for q in chosen]
    rows = source.rows(pages)
    if chosen:
        rows = index_pages(rows, "__html", wanted, keep_html=any(q.kind == "regex" for q in config.queries))
    lists = []
    for n, q in enumerate(config.queries):
        record = _record_of(n, q, kinds, types)
        if q.kind == "regex":
            lists.append(F.transform(find_all(F.col("__html"), q.regex), _of_match(q, config, is_html, record)))
        elif q in chosen:
            k = chosen.index(q)
            if q.merged:
                lists.append(F.array(record(F.lit(0), _merged(q, config, wanted[k], F.col(f"_q{k}")))))
            else:
                lists.append(F.transform(F.col(f"_q{k}"), _of_element(q, config, wanted[k], record)))
    if not lists:
        return source.result(rows.select(*source.inner(), F.lit(0).alias("_query"), F.lit("").alias("_name"), F.lit(0).alias("__pos")), [F.lit(None).cast(t) for t in types.values()], list(types), ("_query", "_name")).limit(0)
    every = rows.select(*source.inner(), F.explode(F.concat(*lists)).alias("_r"))
    every = every.select(*source.inner(), "_r._query", "_r._name", "_r.__pos", *[F.col(f"_r.f{i}").alias(f"__f{i}") for i in range(len(types))])
    return source.result(every, [F.col(f"__f{i}") for i in range(len(types))], list(types), ("_query", "_name"))


__all__ = ["Source", "combined", "compile_config", "compile_query", "fields_of", "groups", "leaf", "regex_records", "scalar_record", "schema_of", "selector_records"]

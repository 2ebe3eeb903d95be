"""The query language: JSON text, dict or file -> frozen dataclasses, which are the logical plan.

Unknown keys are ignored, as are per-rule selectors and query-level transforms; lint() reports them.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ConfigError

__all__ = ["Config", "ConfigError", "Limits", "Output", "Pagination", "Query", "Rule", "Field", "load_config", "loads"]

# The bits of the cleaning stages and their names.
ENTITIES, INVISIBLES, WHITESPACE, FOLD, NUMERIC, NULL_TOKENS = 1, 2, 4, 8, 16, 32
DEFAULT_CLEAN = ENTITIES | INVISIBLES | WHITESPACE
STAGES = {"entities": ENTITIES, "invisibles": INVISIBLES, "whitespace": WHITESPACE, "ws": WHITESPACE, "fold": FOLD, "numeric": NUMERIC, "null_tokens": NULL_TOKENS, "nulls": NULL_TOKENS}
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
FORMATS = ("json", "jsonl", "csv", "txt", "text", "stdout", "none", "null", "memory")
TRANSFORMS = ("trim", "lowercase", "uppercase", "urljoin", "int", "float", "regex_sub")
AGGREGATES = ("count", "exists", "first", "last", "unique", "join")
MAX_PAGES = 1000

_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)


def loads(text: str) -> Any:
    """JSON in which unknown escapes in strings stay as they stand (``\\d``) and lone surrogates become U+FFFD."""
    keep = set('"\\/bfnrt')
    strict = _ESCAPE.sub(lambda m: m[0] if m[1][0] in keep or len(m[1]) == 5 else "\\\\" + m[1], text)
    try:
        value = json.loads(strict, strict=False)
    except ValueError as e:
        raise ConfigError(f"JSON parse error: {e}") from e
    return _mend(value)


def _mend(value: Any) -> Any:
    if isinstance(value, str):
        return re.sub("[\ud800-\udfff]", "�", value)
    if isinstance(value, list):
        return [_mend(x) for x in value]
    if isinstance(value, dict):
        return {_mend(k): _mend(v) for k, v in value.items()}
    return value


def clean_mask(spec: Any) -> int:
    if isinstance(spec, bool):
        return DEFAULT_CLEAN if spec else 0
    if isinstance(spec, int):
        return spec
    names = [spec] if isinstance(spec, str) else spec
    if not isinstance(names, list):
        raise ConfigError("'clean' must be a boolean, a number, a stage name or a list of stage names")
    mask = 0
    for name in names:
        if name not in STAGES:
            raise ConfigError(f"unknown cleaning stage: {name}")
        mask |= STAGES[name]
    return mask


def _typed(node: dict, key: str, kind: type | tuple, default: Any) -> Any:
    value = node.get(key, default)
    if key in node and (not isinstance(value, kind) or isinstance(value, bool) != (kind is bool)):
        raise ConfigError(f"'{key}' has the wrong type: {value!r}")
    return value


def _soft(node: dict, key: str, kind: type | tuple, default: Any) -> Any:
    value = node.get(key)
    return value if isinstance(value, kind) and isinstance(value, bool) == (kind is bool) else default


@dataclass(frozen=True)
class Rule:
    text: bool | None = None
    attribute: str | None = None
    regex: str | None = None
    regex_sub: str | None = None
    transform: tuple[str, ...] = ()
    aggregate: str | None = None
    join_sep: str | None = None
    optional: bool = False
    clean: int | None = None

    @property
    def leaf(self) -> str | None:
        """text before attribute before regex; a key counts by being there, also ``"text": false``."""
        return next((k for k in ("text", "attribute", "regex") if getattr(self, k) is not None), None)

    @staticmethod
    def of(node: dict) -> Rule:
        steps = node.get("transform")
        return Rule(
            _typed(node, "text", bool, None), _typed(node, "attribute", str, None), _typed(node, "regex", str, None), _typed(node, "regex_sub", str, None),
            tuple(steps) if isinstance(steps, list) else (), _typed(node, "aggregate", str, None), _typed(node, "join_sep", str, None),
            _typed(node, "optional", bool, False), clean_mask(node["clean"]) if "clean" in node else None,
        )


@dataclass(frozen=True)
class Field:
    name: str
    rule: Rule


@dataclass(frozen=True)
class Query:
    name: str
    selector: str = ""
    regex: str | None = None
    xpath: str | None = None
    multiple: bool = True
    extract: tuple[Field, ...] = ()

    @property
    def kind(self) -> str:
        return "xpath" if self.xpath is not None else "regex" if self.regex is not None else "selector"

    @property
    def merged(self) -> bool:
        """One record a page: some field aggregates and all elements count."""
        return self.kind == "selector" and self.multiple and any(f.rule.aggregate is not None for f in self.extract)

    @staticmethod
    def of(name: str, node: dict) -> Query:
        items = node.get("extract")
        fields = tuple(Field(_typed(x, "name", str, ""), Rule.of(x["rule"] if "rule" in x else x)) for x in (items if isinstance(items, list) else []))
        return Query(_typed(node, "name", str, name), _typed(node, "selector", str, ""), _typed(node, "regex", str, None), _typed(node, "xpath", str, None), _typed(node, "multiple", bool, True), fields)


@dataclass(frozen=True)
class Pagination:
    type: str = "none"
    param: str | None = None
    start_page: int | None = None
    max_pages: int | None = None
    next_selector: str | None = None
    offset_step: int | None = None
    max_offset: int | None = None
    base_url: str | None = None

    @staticmethod
    def of(node: Any) -> Pagination:
        if not isinstance(node, dict):
            return Pagination()
        kind = node.get("type")
        return Pagination(kind if kind in ("url_param", "next_link", "offset") else "none", *[_typed(node, k, t, None) for k, t in (("param", str), ("start_page", int), ("max_pages", int), ("next_selector", str), ("offset_step", int), ("max_offset", int), ("base_url", str))])


@dataclass(frozen=True)
class Limits:
    max_concurrent: int = 4
    max_retries: int = 0
    retry_delay_ms: int = 1000
    timeout_ms: int = 30000
    requests_per_second: float | None = None
    proxy: str | None = None
    follow_redirects: bool | None = None
    max_redirects: int | None = None


@dataclass(frozen=True)
class Output:
    format: str = "json"
    path: str = ""
    array: bool = True
    csv_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    name: str = "unnamed"
    url: str = ""
    method: str = "GET"
    body: str = ""
    user_agent: str = "PageQuery/1.0"
    clean: int = DEFAULT_CLEAN
    headers: dict[str, str] = field(default_factory=dict)
    limits: Limits = Limits()
    output: Output = Output()
    queries: tuple[Query, ...] = ()
    pagination: Pagination | None = None
    url_list: tuple[str, ...] = ()
    source: Any = None

    @staticmethod
    def of(node: dict) -> Config:
        if not isinstance(node, dict):
            raise ConfigError("a config is a JSON object")
        limits = node.get("limits") if isinstance(node.get("limits"), dict) else {}
        out = node.get("output") if isinstance(node.get("output"), dict) else {}
        queries = node.get("queries") if isinstance(node.get("queries"), dict) else {}
        named = {k: Query.of(k, q) for k, q in queries.items()}
        base = Config()
        return Config(
            *[_soft(node, k, str, getattr(base, k)) for k in ("name", "url", "method", "body", "user_agent")],
            clean_mask(node["clean"]) if "clean" in node else DEFAULT_CLEAN,
            dict(node["headers"]) if isinstance(node.get("headers"), dict) else {},
            Limits(
                *[int(_soft(limits, k, (int, float), getattr(Limits, k))) for k in ("max_concurrent", "max_retries", "retry_delay_ms", "timeout_ms")],
                _soft(limits, "requests_per_second", (int, float), None), _typed(limits, "proxy", str, None), _typed(limits, "follow_redirects", bool, None), _typed(limits, "max_redirects", int, None),
            ),
            Output(_soft(out, "format", str, "json"), _soft(out, "path", str, ""), _soft(out, "array", bool, True), tuple(out["csv_fields"]) if isinstance(out.get("csv_fields"), list) else ()),
            tuple(sorted(named.values(), key=lambda q: q.name.encode())),
            Pagination.of(node["pagination"]) if "pagination" in node else None,
            tuple(node["url_list"]) if isinstance(node.get("url_list"), list) else (),
            node,
        )

    def validate(self, offline: bool = False) -> Config:
        """Raises ConfigError; offline configs need no url."""
        if not offline and not self.url and not self.url_list and self.pagination is None:
            raise ConfigError("one of 'url', 'url_list' and 'pagination' is needed")
        if self.method not in METHODS:
            raise ConfigError(f"unsupported HTTP method: {self.method}")
        if not self.queries:
            raise ConfigError("there are no queries")
        for q in self.queries:
            if not q.selector and q.regex is None and q.xpath is None:
                raise ConfigError(f"query '{q.name}' has no selector, regex or xpath")
        if self.output.format not in FORMATS:
            raise ConfigError(f"unsupported output format: {self.output.format}")
        return self

    def lint(self) -> list[str]:
        """What the config says but the engine doesn't do."""
        notes = []
        for q in self.queries:
            if q.xpath is not None:
                notes.append(f"query '{q.name}': xpath gives no records")
            if q.kind == "selector" and q.selector.strip() == "*":
                notes.append(f"query '{q.name}': the selector * matches nothing")
            node = (self.source or {}).get("queries", {}).get(q.name, {})
            if isinstance(node, dict) and "extract" in node and not isinstance(node["extract"], list):
                notes.append(f"query '{q.name}': extract must be a list; it is ignored")
            if isinstance(node, dict) and "transform" in node:
                notes.append(f"query '{q.name}': a query-level transform is ignored")
            for f, item in zip(q.extract, node.get("extract", []) if isinstance(node, dict) else [], strict=False):
                for step in f.rule.transform:
                    if step in AGGREGATES:
                        notes.append(f"query '{q.name}', field '{f.name}': '{step}' is an aggregate, not a transform; values become strings")
                    elif step not in TRANSFORMS:
                        notes.append(f"query '{q.name}', field '{f.name}': unknown transform '{step}' is ignored")
                if f.rule.aggregate is not None and f.rule.aggregate not in AGGREGATES:
                    notes.append(f"query '{q.name}', field '{f.name}': unknown aggregate '{f.rule.aggregate}' leaves the list")
                if isinstance(item, dict) and "selector" in (item.get("rule") or item):
                    notes.append(f"query '{q.name}', field '{f.name}': a field's selector is ignored")
        if self.pagination and self.pagination.type == "next_link":
            notes.append("pagination next_link fetches the base url only")
        return notes


def load_config(source: Any) -> Config:
    """A Config, dict, JSON text, path of a JSON file, or pathlib.Path."""
    if isinstance(source, Config):
        return source
    if isinstance(source, dict):
        return Config.of(_mend(source))
    if isinstance(source, Path) or (isinstance(source, str) and not source.lstrip().startswith(("{", "["))):
        try:
            return Config.of(loads(Path(source).read_text(encoding="utf-8")))
        except OSError as e:
            raise ConfigError(f"cannot open the config file: {source}") from e
    return Config.of(loads(source))

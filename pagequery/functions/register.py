"""The engine's functions for SQL: cleaning and URLs as SQL functions over built-in expressions, the element index as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..config import DEFAULT_CLEAN
from ..operators.index import elements
from .htmltext import html_text
from .sieve import nulls, sieve
from .transforms import url_join

#: A string, or the name of a function that is an operator or a word of the grammar.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|[=!<>+\-*/%|&^]+(?=\()|\b(?:or|and|not)(?=\()", re.S)


@udtf(returnType="seq int, tag string, open int, inner int, close int, `end` int, html string", useArrow=True)
class HtmlElements:
    def eval(self, html: str) -> Iterator[tuple]:
        for e in elements(html or ""):
            yield e.seq, e.tag, e.open, e.inner, e.close, e.end, html[e.open : e.end]


def sql_of(c: Column) -> str:
    """The expression as SQL that the parser reads: functions whose names are operators go in backticks."""
    return _OPERATOR.sub(lambda m: m[0] if m[0][0] == "'" else f"`{m[0]}`", c._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; those from Column builders stay built-in expressions, without Python workers."""
    text = F.col("s")
    built = {"clean_text(s STRING)": nulls(sieve(text, DEFAULT_CLEAN), DEFAULT_CLEAN), "html_text(s STRING)": html_text(text), "url_join(base STRING, rel STRING)": url_join(F.col("base"), F.col("rel"))}
    for signature, c in built.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {sql_of(c)}")
    spark.udtf.register("html_elements", HtmlElements)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION url_host(url STRING) RETURNS STRING RETURN substring_index(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '@', -1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ascii_lower(s STRING) RETURNS STRING RETURN translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return ["html_elements", "url_host", "ascii_lower", *[signature.partition("(")[0] for signature in built]]

"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled URL table (at most MAX_LABELLED rows, a
parameter) and becomes a literal array of whole-number weights inside the query; scoring is DataFrame
expressions alone, with no shuffle. Weights are rounded to millionths so that sums are exact in any order.

Null urls and urls without ``://`` have an empty host and path, fit no rule and get the model's verdict. A url costs
time in proportion to its length. Of equally long rules that fit, which then are equal texts, the last one listed holds. Rows repeated whole
give equal rows, an empty table an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pick

BUCKETS = 4096
GRAM = 3
MAX_LABELLED = 10_000
SCALE = 1_000_000

#: Labelled examples: 1 for block. Hosts are plain words of either kind of site.
_BLOCK = "spam-farm cheap-pills casino-win ads-track adult-dating free-bets click-bait poker-bonus live-cams pills-online bets-casino slot-machine lucky-jackpot viagra-discount hot-singles payday-loans crypto-doubler miracle-cure weight-loss-secret replica-watches free-prizes win-iphone torrent-warez serial-crack popup-ads banner-clicks email-blast link-farm seo-backlinks gambling-tips"
_ALLOW = "library science-news the-times museum cooking garden-club history weather open-source city-council university local-school public-health railway bird-watching river-trust chess-league astronomy orchestra bakery mountain-rescue book-review village-hall language-course hospital farmers-market bicycle-repair photo-archive physics-journal recipe-box"
_FORMS = (("", "com", "/index.html"), ("www.", "org", "/about/team"), ("blog.", "net", "/2021/05/post"), ("", "info", "/p/123"))
LABELLED = [(f"{www}{name}.{end}", path, label) for names, label in ((_BLOCK, 1), (_ALLOW, 0)) for name in names.split() for www, end, path in _FORMS]


def grams(host: str, path: str) -> list[int]:
    s = f"^{host}|{path}$"
    return [(ord(s[i]) * 17161 + ord(s[i + 1]) * 131 + ord(s[i + 2])) % BUCKETS for i in range(len(s) - GRAM + 1)]


def fit(labelled: list[tuple[str, str, int]], steps: int = 120, rate: float = 0.5, decay: float = 1e-3, max_labelled: int = MAX_LABELLED) -> tuple[list[int], int]:
    """Weights and bias in millionths, by gradient steps over the whole table."""
    if len(labelled) > max_labelled:
        raise ValueError(f"{len(labelled)} labelled urls; the bound is {max_labelled}")
    rows = [(grams(h, p), y) for h, p, y in labelled]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(steps):
        step, db = {}, 0.0
        for g, y in rows:
            err = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(w[i] for i in g))))) - y
            db += err
            for i in g:
                step[i] = step.get(i, 0.0) + err
        n = max(1, len(rows))
        bias -= rate * db / n
        for i, d in step.items():
            w[i] -= rate * (d / n + decay * w[i])
    return [round(x * SCALE) for x in w], round(bias * SCALE)


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    h, slash, p = rule.partition("/")
    return ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)


def logit(host: Column, path: Column, model: tuple[list[int], int]) -> Column:
    """The model's score in millionths: above 0 means block."""
    weights = F.from_json(F.lit(json.dumps(model[0])), "array<bigint>")
    s = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))

    def gram(a: Column, b: Column) -> Column:
        return a * 131 + b

    two = F.zip_with(codes, F.slice(codes, 2, F.char_length(s)), gram)
    three = F.zip_with(two, F.slice(codes, 3, F.char_length(s)), gram)  # null where a gram runs over the end
    return F.aggregate(three, F.lit(model[1]).cast("long"), lambda total, g: total + F.coalesce(F.get(weights, (g % BUCKETS).cast("int")), F.lit(0)))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], model: tuple[list[int], int], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: key, host, path, rule (the longest that fits, else null), verdict, logit_micro.

    rules are (``host/path``, verdict) pairs, a list in the configuration; they become one CASE, longest first.
    """
    host, path = split_url(F.col(url))
    rows = pick(pages, key, url).select(key, host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("logit_micro") > 0, "block").otherwise("allow")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        fit_here = fits(text, F.col("host"), F.col("path"))
        rule, verdict = F.when(fit_here, text).otherwise(rule), F.when(fit_here, what).otherwise(verdict)
    rows = rows.withColumn("logit_micro", logit(F.col("host"), F.col("path"), model))
    return rows.select(key, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "logit_micro")

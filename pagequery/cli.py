"""python -m pagequery.cli CONFIG [OUTPUT] | --bench | --version | --example | --help"""

from __future__ import annotations

import json
import sys
import time

from .api import VERSION, Engine, Stats
from .config import load_config
from .errors import PageQueryError

EXAMPLE = {"name": "example", "url": "http://localhost:8000/", "queries": {"links": {"selector": "a[href]", "extract": [{"name": "href", "rule": {"attribute": "href", "transform": ["urljoin"], "aggregate": "first"}}, {"name": "text", "rule": {"text": True, "aggregate": "first"}}], "multiple": True}}, "output": {"format": "json"}}


def main(args: list[str] | None = None) -> int:
    """0: done; 1: a page failed or the config is bad; 2: wrong usage."""
    args = sys.argv[1:] if args is None else args
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if args else 2
    if args[0] == "--version":
        print(VERSION)
        return 0
    if args[0] == "--example":
        print(json.dumps(EXAMPLE, indent=2))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.compiler import schema_of
    from .sinks import annotate, detect_format, plain, write_file
    from .sources.frontier import frontier
    from .sources.http import fetch_pages

    try:
        config = load_config({"url": "-", **EXAMPLE} if args[0] == "--bench" else args[0]).validate()
        spark = SparkSession.builder.appName(config.name).getOrCreate()
        began = time.perf_counter()
        if args[0] == "--bench":
            card = '<div class="product"><a href="/p/1">Item</a></div>'
            pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit(card * 500).alias("html"))
            n = Engine(config).table(pages).count()
            print(Stats(1000, 1000, 0, n, 1000 * 500 * len(card), time.perf_counter() - began).summary("bench"))
            return 0
        pages = fetch_pages(frontier(spark, config), config).persist()
        # under names that no field has
        renamed = pages.select(F.col("pos").alias("__pos"), F.col("url").alias("__url"), F.col("status").alias("__status"), "url", "html", "error", "bytes")
        engine = Engine(config, keys=("__pos", "__url", "__status"))
        records = engine.records(renamed.filter("error IS NULL")).orderBy("__pos", "_query", "_pos")
        names = {n: list(schema_of(q)) for n, q in enumerate(config.queries)}
        mixed = {c for c, kinds in engine.kinds().items() if len(kinds) > 1}
        rows = annotate(records, "__url", "__status")
        extra = [c for c in ("_url", "_status") if not any(c in n for n in names.values())]

        def as_dict(r) -> dict:
            """The fields of the record's own query, with the page's url and status."""
            own = r.asDict(True)
            return {c: json.loads(own[c])["v"] if c in mixed and own[c] is not None else own[c] for c in names[r["_query"]]} | {c: own[c] for c in extra}

        path = args[1] if len(args) > 1 else config.output.path
        total = 0
        if path:
            fields = list(dict.fromkeys(c for n in names.values() for c in n)) + extra
            name = path.rsplit("/", 1)[-1]
            fmt = None if "." in name else {"stdout": "json", "none": "json", "null": "json", "memory": "json"}.get(config.output.format, config.output.format)
            columns = list(config.output.csv_fields) or fields if detect_format(path, fmt) in ("csv", "txt", "parquet") else None
            total = write_file(rows, path, fmt, columns, as_dict=as_dict)["records"]
        elif config.output.format not in ("none", "null", "memory"):
            for r in rows.toLocalIterator():
                print(json.dumps(plain(as_dict(r)), ensure_ascii=False))
                total += 1
        row = engine.stats(pages, error="error").first()
        stats = Stats(row["pages"], row["succeeded"], row["failed"], total, row["bytes"], time.perf_counter() - began)
        print(stats.summary(config.name), file=sys.stderr)
        return 1 if stats.failed else 0
    except PageQueryError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

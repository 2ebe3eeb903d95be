"""The engine's front door."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import Config, load_config
from .plans.compiler import Source, combined, compile_config, compile_query, scalar_record, schema_of

VERSION = "1.0.0"


def version() -> str:
    return VERSION


def capabilities() -> dict[str, bool]:
    return {"selectors": True, "regex": True, "xpath": False, "http": True, "parquet": True, "streaming": True}


@dataclass
class Stats:
    pages: int = 0
    succeeded: int = 0
    failed: int = 0
    records: int = 0
    bytes: int = 0
    seconds: float = 0.0

    @property
    def pages_per_second(self) -> float:
        return self.pages / self.seconds if self.seconds > 0 else 0.0

    @property
    def megabytes_per_second(self) -> float:
        return self.bytes / 1e6 / self.seconds if self.seconds > 0 else 0.0

    def summary(self, name: str = "unnamed") -> str:
        return f"{name}: {self.succeeded} of {self.pages} pages, {self.failed} failed, {self.records} records, {self.bytes} bytes in {self.seconds:.3f} s ({self.pages_per_second:.1f} pages/s, {self.megabytes_per_second:.2f} MB/s)"


class Engine:
    """A compiled config over DataFrames of pages."""

    def __init__(self, config: Any, html: str = "html", url: str | None = "url", keys: tuple[str, ...] = ("page_id",), is_html: bool = True):
        self.config: Config = load_config(config)
        self.source, self.is_html = Source(html, url, keys), is_html

    def tables(self, pages: DataFrame) -> dict[str, DataFrame]:
        """Query name -> typed records; each table's plan indexes the pages for its own query. For all in one pass see records()."""
        return compile_config(self.config, pages, self.source, self.is_html)

    def table(self, pages: DataFrame, name: str | None = None) -> DataFrame:
        query = next((q for q in self.config.queries if name in (None, q.name)), None)
        if query is None:
            raise KeyError(name)
        return compile_query(query, self.config, pages, self.source, self.is_html)

    def records(self, pages: DataFrame) -> DataFrame:
        """All queries in one pass over the pages: keys, _query (its number in order of names), _name, _pos, and the union of all fields, as JSON where types differ."""
        return combined(self.config, pages, self.source, self.is_html)

    def kinds(self) -> dict[str, set[str]]:
        """Field -> its types over all queries; more than one type makes records() give JSON."""
        out: dict[str, set[str]] = {}
        for q in self.config.queries:
            for name, kind in schema_of(q).items():
                out.setdefault(name, set()).add(kind)
        return out

    def scalar(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        query = next(q for q in self.config.queries if name in (None, q.name))
        return scalar_record(rows, query, self.source, self.is_html)

    def stats(self, pages: DataFrame, error: str | None = None) -> DataFrame:
        """One row of run totals; pages whose error column is set have failed."""
        bad = F.col(error).isNotNull() if error else F.lit(False)
        size = F.sum(F.octet_length(F.col(self.source.html)))
        return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))


def run_offline(spark: SparkSession, config: Any, html: str, base_url: str = "", is_html: bool = True) -> tuple[list[dict], Stats]:
    """Records of one page in memory, in the order of the queries' names, and the run's numbers."""
    began = time.perf_counter()
    engine = Engine(load_config(config).validate(offline=True), is_html=is_html)
    pages = spark.createDataFrame([(0, base_url, html)], "page_id long, url string, html string")
    out = []
    for t in engine.tables(pages).values():
        fields = [c for c in t.columns if c not in ("page_id", "_pos")]
        out += [{c: r[c] for c in fields} for r in t.orderBy("_pos").collect()]
    stats = Stats(1, 1, 0, len(out), len(html.encode()), time.perf_counter() - began)
    return out, stats


def extract(spark: SparkSession, config: Any, html: str, base_url: str = "", is_html: bool = True) -> list[dict]:
    return run_offline(spark, config, html, base_url, is_html)[0]


@dataclass
class ScrapeResult:
    """Records and numbers of a run."""

    records: list[dict]
    stats: Stats

    def __len__(self) -> int:
        return len(self.records)

    def __iter__(self):
        return iter(self.records)

    def to_dataframe(self, spark: SparkSession, flat: bool = False, coerce: bool = False) -> DataFrame:
        """The records as a DataFrame; flat: scalar columns; coerce: numbers where columns hold them."""
        df = sinks.records_frame(spark, self.records)
        df = sinks.flatten(df) if flat or coerce else df
        return sinks.coerce_numbers(df) if coerce else df

    def export(self, spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None) -> dict:
        return sinks.export_records(spark, self.records, path, fmt, columns)


def scrape(spark: SparkSession, config: Any) -> ScrapeResult:
    """Fetches the config's urls and extracts: its records with _url and _status, collected. For many pages use fetch_pages and Engine."""
    from .sources.frontier import frontier
    from .sources.http import fetch_pages

    began = time.perf_counter()
    config = load_config(config).validate()
    pages = fetch_pages(frontier(spark, config), config).persist()
    renamed = pages.select(F.col("pos").alias("__pos"), F.col("url").alias("__url"), F.col("status").alias("__status"), "url", "html", "error")
    engine = Engine(config, keys=("__pos", "__url", "__status"))
    names, mixed = {n: list(schema_of(q)) for n, q in enumerate(config.queries)}, {c for c, k in engine.kinds().items() if len(k) > 1}
    records = []
    for r in engine.records(renamed.filter("error IS NULL")).orderBy("__pos", "_query", "_pos").toLocalIterator():
        own = r.asDict(True)
        fields = {c: json.loads(own[c])["v"] if c in mixed and own[c] is not None else own[c] for c in names[r["_query"]]}
        records.append({"_url": own["__url"], "_status": own["__status"]} | fields)
    row = engine.stats(pages, error="error").first()
    pages.unpersist()
    return ScrapeResult(records, Stats(row["pages"], row["succeeded"], row["failed"], len(records), row["bytes"], time.perf_counter() - began))


def scrape_file(spark: SparkSession, path: str) -> ScrapeResult:
    """scrape() of a config file."""
    return scrape(spark, Path(path))


def backend_info() -> dict[str, Any]:
    """What runs the queries."""
    import pyspark

    return {"engine": "pagequery", "version": VERSION, "backend": "spark", "spark": pyspark.__version__, "capabilities": capabilities()}

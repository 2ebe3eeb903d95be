"""Extraction over streams of pages: the same plans, as all of them are stateless."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..api import Engine


def extract_stream(pages: DataFrame, config: Any, name: str | None = None, **columns: Any) -> DataFrame:
    """Records of one query from a streaming DataFrame of pages."""
    return Engine(config, **columns).table(pages, name)


def new_urls(stream: DataFrame, url: str = "url", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The frontier's first occurrences within the watermark; state for a url goes after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def read_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)

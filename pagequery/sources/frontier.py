"""The url frontier of a config as a DataFrame (pos, url): single url, list, pagination, first occurrence kept in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_PAGES, Config, Pagination


def page_url(base: Column, pages: Pagination, page: Column) -> Column:
    if pages.type == "url_param" and pages.param is not None:
        return F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit(pages.param + "="), page.cast("string"))
    if pages.type == "offset" and pages.offset_step is not None:
        return F.concat(base, F.lit("?offset="), ((page - 1) * pages.offset_step).cast("string"))
    return base


def paginate(bases: DataFrame, pages: Pagination, url: str = "url") -> DataFrame:
    """Every base url's pages in order; columns of bases, then ``page`` and ``page_url``. next_link pages all are the base url."""
    first = 1 if pages.start_page is None else pages.start_page
    last = MAX_PAGES if pages.max_pages is None else pages.max_pages
    if pages.type == "none":
        return bases.filter(F.col(url) != "").select("*", F.lit(first).alias("page"), F.col(url).alias("page_url"))
    numbers = F.sequence(F.lit(first), F.lit(last)) if first <= last else F.array().cast("array<int>")
    return bases.select("*", F.explode(numbers).alias("page")).withColumn("page_url", page_url(F.col(url), pages, F.col("page")))


def dedup(urls: DataFrame, pos: str = "pos", url: str = "url") -> DataFrame:
    """One row a url, at its first position; a partial minimum goes over the shuffle, never the repeats."""
    return urls.groupBy(url).agg(F.min(pos).alias(pos)).select(pos, url)


def frontier(spark: SparkSession, config: Config) -> DataFrame:
    """pos and url of everything the config asks for; with pagination the list is ignored."""
    if config.pagination is not None:
        base = config.url or config.pagination.base_url or ""
        rows = spark.createDataFrame([(base,)] if config.url or config.pagination.base_url is not None else [], "url string")
        urls = paginate(rows, config.pagination).select(F.col("page").cast("long").alias("pos"), F.col("page_url").alias("url"))
    else:
        listed = [u for u in (config.url, *config.url_list) if u or u is not config.url]
        urls = spark.createDataFrame(list(enumerate(listed)), "pos long, url string")
    return dedup(urls)

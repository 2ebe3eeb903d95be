"""Pages and bulk texts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: url (its path) and html."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row a line, for bulk-text configs."""
    return spark.read.text(path).select(F.input_file_name().alias("url"), F.col("value").alias("html"))

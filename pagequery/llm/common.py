"""Helpers shared by the training-data operators.

Words everywhere are runs of characters outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` cuts at
exactly these six bytes, so the Python side never needs a regular expression for them.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: space and \t \n \v \f \r
BLANKS = " \t\n\x0b\x0c\r"


#: Bytes of one Arrow batch to a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch, so that a worker's memory doesn't follow the length of texts (a single longer text still is one batch)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub("[^0-9-]", "", spark.conf.get(name))) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling; whatever else df holds (also names that differ only in case) is left out."""
    bound_batches(df.sparkSession)
    where = {}
    for i, c in enumerate(df.columns):
        where.setdefault(c, i)
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"__c{where[n]}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local one if all runs in this process, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='pagequery-')}"
            atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), True)
        where = _OWN[app]
    return where.rstrip("/")


#: Local folders of applications whose session names no shared one.
_OWN: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has already ended; its scratch folder is the cluster's to clean
        return


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Tables of large rows need group, the most rows of a row group, as writers and readers hold a whole one (100 rows at least
    without it); they are not packed, so that what Spark reads into a task is as large as its part of the file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.block.row.count.limit": group, "parquet.enable.dictionary": "false", "compression": "uncompressed"} if group else {}
    df.write.options(**options).parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(col: str = "doc_id") -> Column:
    """An id as text; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(id_text(col).cast("binary")), F.lit(folds))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(col))).alias("n")).first()["n"] or 0)


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns named by position, so that columns added to it clash with none, and its own names."""
    bound_batches(df.sparkSession)
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))]), list(df.columns)


def map_text(df: DataFrame, schema: str, make: Callable[[], Callable[[list, dict], dict]], text: str = "text", keep_text: bool = False) -> DataFrame:
    """mapInArrow over the rows of df: make() runs once a task and gives f(texts as bytes or None, other columns).

    f returns the columns to append (lists, numpy or Arrow arrays); the columns of df other than
    the text (with keep_text, all) come first in the result, unchanged.
    """
    keep = [c for c in df.columns if keep_text or c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            own = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            cols = {**own, **f(texts, own)}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols))

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{head}, {schema}" if head else schema)

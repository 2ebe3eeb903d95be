"""Flattening and writing of records."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, MapType, StringType, StructType

from .errors import OutputError
from .functions.aggregates import json_number

SUPPORTED_FORMATS = ("txt", "json", "jsonl", "csv", "parquet")
ALIASES = {"text": "txt", "tsv": "csv", "pq": "parquet", "pqt": "parquet", "jsonlines": "jsonl", "ndjson": "jsonl"}


def print_double(x: Column) -> Column:
    """15 significant digits, shortest form."""
    size = F.abs(x)
    digits = F.floor(F.log10(F.when(size > 0, size).otherwise(1.0))).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.round(x.cast("decimal(38,18)"), 15).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(digits.between(-5, 14), plain).otherwise(F.regexp_replace(F.format_string("%.14e", x), r"\.?0*e", "e"))


def _engine_text(c: Column, kind) -> Column:
    if isinstance(kind, BooleanType):
        return F.when(c, "true").when(~c, "false")
    return print_double(c) if isinstance(kind, (DoubleType, FloatType)) else c.cast("string")


def engine_flat(c: Column, kind) -> Column:
    """A field as the engine's CSV text: null and [] empty, one value bare, more joined by "; "."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(_engine_text(x, kind.elementType), F.lit(""))), "; "), F.lit(""))
    return F.coalesce(_engine_text(c, kind), F.lit(""))


def _python_text(c: Column, kind) -> Column:
    if isinstance(kind, BooleanType):
        return F.when(c, "True").when(~c, "False")
    return F.when(c == F.floor(c), F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string")) if isinstance(kind, DoubleType) else c.cast("string")


def flat(c: Column, kind) -> Column:
    """A field as an export's scalar: [] null, one value bare, more joined by "; ", structures as JSON."""
    if isinstance(kind, ArrayType):
        parts = F.transform(c, lambda x: F.coalesce(_python_text(x, kind.elementType), F.lit("")))
        one = F.get(c, F.lit(0)).cast("string") if not isinstance(kind.elementType, (BooleanType, DoubleType)) else _python_text(F.get(c, F.lit(0)), kind.elementType)
        return F.when(F.size(c) == 1, one).when(F.size(c) > 1, F.array_join(parts, "; "))
    return F.to_json(c) if isinstance(kind, (StructType, MapType)) else c


def flatten(df: DataFrame, columns: list[str] | None = None, engine: bool = False) -> DataFrame:
    """Scalar columns, in the order asked for; a column that df lacks is null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    how = engine_flat if engine else flat
    return df.select(*[how(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.lit("" if engine else None).cast("string").alias(c) for c in (columns or df.columns)])


def coerce_numbers(df: DataFrame, share: float = 0.9) -> DataFrame:
    """String columns become numbers where at least that share of their values are; one pass decides for all columns."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not names:
        return df
    as_number = {c: F.trim(F.col(f"`{c}`")).try_cast("double") for c in names}
    whole = {c: F.col(f"`{c}`").rlike(r"^\s*[+-]?[0-9]{1,18}\s*$") for c in names}
    counts = df.agg(*[x for i, c in enumerate(names) for x in (F.count(f"`{c}`").alias(f"n{i}"), F.count(as_number[c]).alias(f"k{i}"), F.count_if(whole[c]).alias(f"w{i}"))]).first()
    new = {}
    for i, c in enumerate(names):
        n, k, w = counts[f"n{i}"], counts[f"k{i}"], counts[f"w{i}"]
        if n and k >= max(1, int(share * n)):
            new[c] = F.trim(F.col(f"`{c}`")).try_cast("bigint") if w == k == n else as_number[c]
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def detect_format(path: str, fmt: str | None = None) -> str:
    name = fmt.lower().lstrip(".") if fmt else Path(path).suffix.lower().lstrip(".")
    if not name:
        raise ValueError("the path has no extension; name a format")
    return ALIASES.get(name, name)


def plain(value: Any) -> Any:
    """A collected value for json.dumps: numbers that are not finite are null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def write(df: DataFrame, path: str, fmt: str | None = None, columns: list[str] | None = None, mode: str = "overwrite", delimiter: str = ",", coerce: bool = True) -> dict:
    """Distributed writers: a folder of part files (json: an array in each). Returns path, format and the columns written."""
    kind = detect_format(path, fmt)
    if kind not in SUPPORTED_FORMATS:
        raise OutputError(f"unsupported format: {kind}")
    chosen = df.select(*[f"`{c}`" for c in columns if c in df.columns]) if columns and kind in ("json", "jsonl") else df
    if kind == "jsonl":
        json_lines(chosen).write.mode(mode).text(path)
    elif kind == "json":
        _arrays(json_lines(chosen)).write.mode(mode).text(path)
    elif kind == "csv":
        flatten(df, columns, engine=True).write.mode(mode).option("header", "true").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("nullValue", "").option("sep", delimiter).csv(path)
    elif kind == "txt":
        text_records(df, columns).write.mode(mode).text(path)
    else:
        ready = coerce_numbers(flatten(df, columns)) if coerce else flatten(df, columns)
        ready.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3").option("parquet.page.size", str(1 << 20)).parquet(path)
    return {"path": path, "format": kind, "columns": columns or df.columns}


def text_records(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``key: value`` lines of each record: the columns asked for first, then the rest; without any, in order of names. Records are numbered from 1 in order of partitions."""
    rest = [c for c in df.columns if c not in (columns or ())]
    names = [c for c in columns if c in df.columns] + rest if columns else sorted(rest)
    rows = flatten(df, names, engine=True)
    body = [F.concat(F.lit(f"{c}: "), F.col(f"`{c}`")) for c in names]
    place = F.monotonically_increasing_id()
    rows = rows.select(F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_row"), F.concat_ws("\n", *body, F.lit("")).alias("_body"))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in counts):
        offsets.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    number = (F.col("_before") + F.col("_row") + 1).cast("string")
    return rows.join(F.broadcast(offsets), "_part").select(F.concat(F.lit("--- record "), number, F.lit(" ---\n"), F.col("_body")).alias("value"))


def json_text(c: Column, kind) -> Column:
    """A value as JSON: doubles as the engine prints them, null for null."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(json_number(c.cast("double")), F.lit("null"))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]")), F.lit("null"))
    if isinstance(kind, (StructType, MapType)):
        return F.coalesce(F.to_json(c), F.lit("null"))
    if isinstance(kind, StringType):
        return F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_lines(df: DataFrame) -> DataFrame:
    """One column, value: each row as a JSON object with its keys in order."""
    parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), json_text(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    return df.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def _arrays(lines: DataFrame) -> DataFrame:
    """The lines of each partition as one JSON array."""

    def run(batches):
        held = None
        for b in batches:
            rows = b.column(0).to_pylist()
            if not rows:
                continue
            out = ([held + ","] if held is not None else []) + [("[" if held is None and i == 0 else "") + x + "," for i, x in enumerate(rows[:-1])]
            held = ("[" if held is None and len(rows) == 1 else "") + rows[-1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + "]"])], names=["value"])

    return lines.mapInArrow(run, "value string")


def write_file(df: DataFrame, path: str, fmt: str | None = None, columns: list[str] | None = None, delimiter: str = ",", as_dict: Callable[[Row], dict] | None = None) -> dict:
    """One local file through the driver, a partition at a time: for results that a person reads. as_dict makes a row's JSON object. Returns path, format, bytes, records."""
    kind = detect_format(path, fmt) if fmt or Path(path).suffix else "jsonl"
    target = Path(path) / f"results.{kind}" if Path(path).is_dir() else Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    if kind == "parquet":
        return {"path": str(target), "format": kind, "records": _parquet_file(flatten(df, columns), target), "bytes": target.stat().st_size}
    with target.open("w", encoding="utf-8", newline="") as f:
        if kind == "json":
            f.write("[")
        if kind == "csv":
            import csv

            rows = flatten(df, columns, engine=True)
            out = csv.writer(f, delimiter=delimiter, lineterminator="\n")
            out.writerow(rows.columns)
            for r in rows.toLocalIterator():
                out.writerow(list(r))
                n += 1
        elif kind == "txt":
            names = columns or sorted(df.columns)
            for r in flatten(df, names, engine=True).toLocalIterator():
                n += 1
                f.write(f"--- record {n} ---\n" + "".join(f"{c}: {r[c]}\n" for c in names) + "\n")
        elif kind in ("json", "jsonl"):
            for r in (df.select(*columns) if columns else df).toLocalIterator():
                text = json.dumps(plain(as_dict(r) if as_dict else r.asDict(True)), ensure_ascii=False)
                f.write(("\n  " if n == 0 else ",\n  ") + text if kind == "json" else text + "\n")
                n += 1
            if kind == "json":
                f.write("\n]\n" if n else "]\n")
        else:
            raise OutputError(f"unsupported format for one file: {kind}")
    return {"path": str(target), "format": kind, "bytes": target.stat().st_size, "records": n}


ROW_GROUP = 64_000


def _parquet_file(df: DataFrame, target: Path) -> int:
    """Numbers where columns hold them, row groups of ROW_GROUP rows; dictionaries where they pay."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    ready = coerce_numbers(df)
    schema, rows, n = to_arrow_schema(ready.schema), [], 0
    with pq.ParquetWriter(str(target), schema, compression="zstd", compression_level=3, use_dictionary=[f.name for f in schema if pa.types.is_string(f.type)]) as out:
        for r in ready.toLocalIterator():
            rows.append(r.asDict())
            n += 1
            if len(rows) == ROW_GROUP:
                out.write_table(pa.Table.from_pylist(rows, schema))
                rows = []
        if rows:
            out.write_table(pa.Table.from_pylist(rows, schema))
    return n


def export_records(spark: SparkSession, records: list[dict], path: str, fmt: str | None = None, columns: list[str] | None = None, delimiter: str = ",") -> dict:
    """Records in memory to one file. Returns path, format, bytes, records."""
    return write_file(records_frame(spark, records), path, fmt, columns, delimiter)


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records in memory as a DataFrame: columns in order of first appearance; a field of several types becomes JSON text."""
    names = list(dict.fromkeys(k for r in records for k in r))
    if not names:
        return spark.createDataFrame([], "`_none` string").drop("_none")
    table = {}
    for name in names:
        values = [plain(r.get(name)) for r in records]
        try:
            table[name] = pa.array(values)
            if pa.types.is_null(table[name].type) or str(table[name].type) == "list<item: null>":
                table[name] = table[name].cast(pa.string() if pa.types.is_null(table[name].type) else pa.list_(pa.string()))
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            table[name] = pa.array([None if v is None else json.dumps(v, ensure_ascii=False) for v in values])
    return spark.createDataFrame(pa.table(table))


def annotate(df: DataFrame, url: str, status: str) -> DataFrame:
    """The page's url and status as _url and _status, unless fields have these names."""
    for name, source in (("_url", url), ("_status", status)):
        if name not in df.columns:
            df = df.withColumn(name, F.col(source))
    return df


__all__ = ["SUPPORTED_FORMATS", "annotate", "coerce_numbers", "detect_format", "export_records", "flatten", "json_lines", "records_frame", "text_records", "write", "write_file"]

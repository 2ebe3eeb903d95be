"""Corpus-wide line deduplication in DataFrame operations alone.

Every line of a document becomes a 96-bit hash of its key with document and position. The hashes
are range-partitioned, sorted within a range by document and position, and streamed once: where
the document of a hash changes, another document begins. The range key ends in a salt taken from
the document, so one line that fills a third of the corpus is dealt over many ranges; each range
sends one partial count per hash on. Documents get back run-length-coded keep bitmaps, never text.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys shorter than
min_chars code points (blank lines) are never dropped. A null text is one empty line.
A document is an id: rows that share one count as one document, whatever their texts, and each loses its own lines; null is an id like
another. Rows repeated whole get the same bitmap. Other columns than those asked for are left out; an empty table gives an empty result. A
whole-number id is told apart exactly (its hash is a permutation), any other by 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, pick, written

SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """lower() has a fast path for ASCII and changes A-Z alone there; other lines are translated."""
    cut = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def _doc_key(key: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(key)).alias("_d1"), F.xxhash64(F.col(text)).alias("_d2")]


def line_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """One row per countable line: document (_d1, of the id; _d2, of the text), key hash (h1, h2), position."""
    keys = F.transform(lines_of(F.col(text)), line_key)
    rows = docs.select(*_doc_key(key, text), F.posexplode(keys).alias("pos", "_k")).filter(F.char_length("_k") >= min_chars)
    return rows.select("_d1", "_d2", F.xxhash64("_k").alias("h1"), F.hash("_k").alias("h2"), "pos")


def line_counts(lines: DataFrame) -> DataFrame:
    """h1, h2, documents that hold it, and the first of them with the position there (in hash order of documents)."""
    ranged = lines.withColumn("_salt", F.pmod("_d1", F.lit(SALTS))).repartitionByRange("h1", "h2", "_salt")
    stream = Window.partitionBy("h1", "h2", "_salt").orderBy("_d1", "_d2", "pos")
    same = F.lag("_d1").over(stream).eqNullSafe(F.col("_d1"))
    firsts = ranged.withColumn("_again", same).filter(~F.col("_again"))
    return firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("_d1", "_d2", "pos")).alias("first"))


def _runs(drops: Column, n: Column) -> Column:
    """Sorted dropped positions as run lengths: kept, dropped, kept, ... ; they sum to n."""
    starts = F.filter(drops, lambda p, i: (i == 0) | (p != F.get(drops, i - 1) + 1))
    ends = F.filter(drops, lambda p, i: (i == F.size(drops) - 1) | (p != F.get(drops, i + 1) - 1))
    pairs = F.transform(starts, lambda s, i: F.array(s - F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1), F.get(ends, i) - s + 1))
    return F.concat(F.flatten(pairs), F.array(n - (F.element_at(drops, -1) + 1)))


def keep_bits(runs: Column) -> Column:
    """The bitmap that run lengths stand for: true for kept lines."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def kept_text(text: Column, runs: Column) -> Column:
    """The kept lines joined by a newline."""
    lines = lines_of(text)
    flagged = F.arrays_zip(lines.alias("l"), keep_bits(runs).alias("k"))
    kept = F.transform(F.filter(flagged, lambda x: x["k"]), lambda x: x["l"])
    return F.when(F.size(runs) <= 1, F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of documents that lose lines: _d1, _d2, and the sorted dropped positions.

    A line is dropped if at least min_docs documents hold its key (repeats within one document alone
    never count); with keep_first its first occurrence in the corpus stays.
    """
    lines = written(line_hashes(docs, key, text, min_chars), "lines")
    # written first: with exchanges alone on both sides Spark can split a hot line's partition, or broadcast a small table
    frequent = written(line_counts(lines).filter(F.col("n_docs") >= min_docs), "frequent")
    gone = lines.join(frequent, ["h1", "h2"])
    if keep_first:
        gone = gone.filter(F.struct("_d1", "_d2", "pos") != F.col("first"))
    return gone.groupBy("_d1", "_d2").agg(F.array_sort(F.collect_set("pos")).alias("_drops"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, text, the columns named in also, n_lines, n_dropped and ``keep`` (run lengths: kept, dropped, kept, ...)."""
    docs = pick(docs, key, text, *also)
    drops = line_bitmaps(docs, min_docs, min_chars, keep_first, key, text)
    both = docs.select("*", *_doc_key(key, text)).join(drops, ["_d1", "_d2"], "left")
    n = F.size(lines_of(F.col(text)))
    return both.select(
        key, text, *also, n.cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.size("_drops") > 0, _runs(F.col("_drops"), n)).otherwise(F.array(n)).alias("keep"),
    )

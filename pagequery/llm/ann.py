"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Index: unit vectors are rotated by a fixed random orthogonal matrix and kept as sign bits with one correction scalar (the
inner product of a vector with its own code). A query, rotated and rounded to QUERY_BITS bits a
component, meets the packed bits in and-plus-bit-count operations; the estimate divided by the
correction has an error bound of EPSILON standard deviations. Per block, every vector whose upper bound
reaches the k-th best lower bound is scored exactly on the original vectors in double precision.

All rows are indexed; nothing is trained. Index and queries lie in blocks of bounded size in scratch tables; every query
block meets every index block in a product of the two tables, which copies nothing through a shuffle or the driver. A task streams its part of the
index past its query blocks and returns k rows per query, so the merge sees k rows per query and part. Vectors lie as single floats where that loses nothing.
Blocks are large, so that a byte of vectors moves once for a few hundred bounds that are worked out.
Vectors that are null, zero, or hold null or non-finite components take no part; neither do null
ids. Cosines are taken on vectors scaled by a power of two, which changes no digit and keeps squares finite. Vectors of different
lengths never meet. Rows that share an id each are a candidate, and each a query of its own with its own ranks; a query never meets its own row. Ties go to
the smaller id. Empty tables give empty results; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

SEED = 7919
EPSILON = 3.0
QUERY_BITS = 6
#: Bytes of vectors in an index block and a query block.
BLOCK_BYTES = 1 << 20
QUERY_BYTES = 1 << 20
#: Blocks in a row group of the scratch tables.
GROUP_BLOCKS = 8
#: Query blocks of a task, about, and the least number of tasks that query blocks are dealt to. A task holds its query blocks at once.
TASK_QUERIES, LEAST_TASKS = 16, 8
#: Results that a task holds before it returns them, about.
HELD_ROWS = 1 << 21


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (rows of uint64 words, padded with zeros) and correction scalars."""
    dim, vectors = vectors.shape[1], scaled(vectors)
    turned = (vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ rotation(dim).T
    bits = np.zeros((len(vectors), -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = turned > 0
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return codes, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def estimates(codes: np.ndarray, corrections: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of rotated unit queries with all coded vectors (a row per query), and the bounds of their errors."""
    dim = turned.shape[1]
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    levels = np.rint((turned - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    total = np.zeros((len(turned), len(codes)), np.int64)
    for k in range(QUERY_BITS):
        plane = np.zeros((len(turned), codes.shape[1] * 64), np.uint8)
        plane[:, :dim] = (levels >> k) & 1
        plane = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
        for w in range(codes.shape[1]):
            total += np.bitwise_count(codes[None, :, w] & plane[:, None, w]).astype(np.int64) << k
    inner = (2 * (low * ones + step * total) - (low * dim + step * levels.sum(axis=1, dtype=np.int64, keepdims=True))) / np.sqrt(dim)
    error = EPSILON * np.sqrt(np.maximum(1 - corrections**2, 0) / max(dim - 1, 1)) + step * np.sqrt(dim) / 2
    return inner / corrections, error / corrections


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to 0.5 to 1."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def narrowed(vectors: np.ndarray) -> np.ndarray:
    """Single floats, if they hold the same numbers."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if (single == vectors).all() else vectors


def unpacked(data: bytes, dim: int, count: int) -> np.ndarray:
    """Packed vectors, a row each, as the single or double floats they were packed as."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim * count else np.float64).reshape(count, dim)


def _blocks(size: int):
    """Rows (id, vector, asked) -> blocks of one vector length: length, row numbers, ids, marks of queries, vectors, codes and corrections as packed bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def block(dim: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            rows, own, asked, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            cols = [rows, own, asked, narrowed(v), *encode(v)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([x.tobytes()]) for x in cols]], names=["dim", "rows", "ids", "asked", "vectors", "codes", "corrections"])

        for b in batches:
            ids, lists = b.column(0), b.column(1)
            asked = b.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
            ends = np.concatenate(([0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))))
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            lengths = np.diff(ends)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero((lengths == dim) & known)
                v = flat[ends[rows][:, None] + np.arange(dim)]
                ok = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                rows, v = rows[ok], v[ok]
                own = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
                each = max(1, size // (8 * dim))
                for at in range(0, len(v), each):
                    parts = held.setdefault(dim, [])
                    one = slice(at, at + each)
                    parts.append((number + rows[one], own[one], asked[rows[one]], v[one]))
                    if sum(len(x[0]) for x in parts) >= each:
                        yield block(dim, held.pop(dim))
            number += len(ids)
        for dim, parts in held.items():
            yield block(dim, parts)

    return run


BLOCK_SCHEMA = "dim int, rows binary, ids binary, asked binary, vectors binary, codes binary, corrections binary"


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def merged(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """Results (query row, query id, id, score) -> each query row's k best, ties to the smaller id."""
    rows, q_ids, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -scores, rows))
    own = rows[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    order = order[np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < k]
    return [x[order] for x in (rows, q_ids, ids, scores)]


def _search(k: int):
    """Pairs of an index block and a query block -> the k best of each query in all its pairs of the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                codes, corrections = np.frombuffer(r["codes"], np.uint64).reshape(len(ids), -1), np.frombuffer(r["corrections"], np.float64)
                q_rows, q_ids = np.frombuffer(r["q_rows"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                v, q = (scaled(unpacked(x, dim, n).astype(np.float64)) for x, n in ((r["vectors"], len(ids)), (r["q_vectors"], len(q_ids))))
                size, q_size = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
                turned = (q / q_size[:, None]) @ rotation(dim).T
                out: list[list[np.ndarray]] = []
                for first in range(0, len(q_ids), 32):
                    group = q_rows[first : first + 32]
                    other = rows[None, :] != group[:, None]
                    guess, error = estimates(codes, corrections, turned[first : first + 32])
                    lower = np.where(other, guess - error, -np.inf)
                    floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(group), -np.inf)
                    hits = other & (guess + error >= floor[:, None])
                    for i, own in enumerate(group.tolist()):
                        at = np.flatnonzero(hits[i])
                        scores = (v[at] @ q[first + i]) / (size[at] * q_size[first + i])
                        top = best(ids[at], scores, k)
                        out.append([np.full(len(top), own), np.full(len(top), q_ids[first + i]), ids[at][top], scores[top]])
                block = int(q_rows[0])  # a row asks in one block only
                held[block] = merged([held[block], *out] if block in held else out, k)
                if sum(len(x[0]) for x in held.values()) > HELD_ROWS:
                    yield from _results(held)
                    held = {}
        yield from _results(held)

    return run


def _results(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for found in held.values():
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["q_row", "query_id", "vec_id", "score"])


def _queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the rows that ask."""
    for b in batches:
        for r in b.to_pylist():
            own = np.frombuffer(r["asked"], np.uint8) == 1
            if own.any():
                kept = [np.frombuffer(r["rows"], np.int64)[own], np.frombuffer(r["ids"], np.int64)[own], unpacked(r["vectors"], r["dim"], len(own))[own]]
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), *[pa.array([x.tobytes()]) for x in kept]], names=["q_dim", "q_rows", "q_ids", "q_vectors"])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries put together to blocks of about QUERY_BYTES, single and double floats apart."""
    held: dict[tuple[int, int], list[tuple]] = {}

    def block(kind: tuple[int, int]) -> pa.RecordBatch:
        parts = held.pop(kind)
        return pa.RecordBatch.from_arrays([pa.array([kind[0]], pa.int32()), *[pa.array([b"".join(x)]) for x in zip(*parts, strict=True)]], names=["q_dim", "q_rows", "q_ids", "q_vectors"])

    for b in batches:
        for r in b.to_pylist():
            kind = r["q_dim"], len(r["q_vectors"]) // len(r["q_rows"])
            held.setdefault(kind, []).append((r["q_rows"], r["q_ids"], r["q_vectors"]))
            if sum(len(x[2]) for x in held[kind]) >= QUERY_BYTES:
                yield block(kind)
    for kind in list(held):
        yield block(kind)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors that meets asked (a condition on the key), its k nearest other rows."""
    spark = vectors.sparkSession
    rows = pick(vectors, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), asked.alias("asked"))
    blocks = written(rows.mapInArrow(_blocks(BLOCK_BYTES), BLOCK_SCHEMA), "blocks", GROUP_BLOCKS)
    q_schema = "q_dim int, q_rows binary, q_ids binary, q_vectors binary"
    # dealt by length into few tasks, so that blocks of queries are as large as they may be
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = blocks.select("dim", "rows", "ids", "asked", "vectors").mapInArrow(_queries, q_schema)
    queries = written(few.repartition(parts, F.pmod(F.xxhash64("q_rows"), F.lit(max(1, parts // 4)))).mapInArrow(_joined, q_schema), "queries", GROUP_BLOCKS)
    # rows here are blocks: a task holds a few query blocks, the right side, and streams a part of the index past them; the hint
    # keeps either side from being broadcast, and the condition, being no equation, from being sorted and shuffled
    queries = queries.coalesce(max(LEAST_TASKS, -(-queries.count() // TASK_QUERIES)))
    index = blocks.drop("asked").coalesce(max(1, -(-parts // max(1, queries.rdd.getNumPartitions()))))
    pairs = index.hint("shuffle_replicate_nl").join(queries, (F.col("dim") >= F.col("q_dim")) & (F.col("dim") <= F.col("q_dim")))
    found = pairs.drop("q_dim").mapInArrow(_search(k), "q_row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

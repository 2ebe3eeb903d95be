"""Exact repeated passages across a corpus, by fixed-block anchors.

Every text's words are cut into reference blocks of ``anchor`` = (width + 1) // 2 words that don't overlap;
any window of ``width`` words holds one whole. Blocks are the index, every rolling window of anchor words is a
probe. A probe that meets a block elsewhere is a hit; hits extend to the windows of ``width`` words
around them, whose 96-bit hashes decide, and runs of repeated windows are the maximal exact repeats.

Texts are dealt to batches of about BATCH_BYTES and kept as a bucketed table in the shared folder, many batches a bucket, so the
three passes over them shuffle no text. Rows are dealt by id, text and a salt from their place in the input, so rows repeated whole
spread over all batches. What moves between batches and hash ranges is packed: a batch sends
each different hash once (twice if it occurs more often), so a passage in a third of all texts
costs a range one entry a batch. The numbers of batches and ranges follow the input without a cap; a batch sends at most a message a
word. Only buckets stop at MAX_BUCKETS, Spark's own bound: beyond it a bucket holds more batches, which still are handled one by one.

Null texts have no words. Rows repeated whole are documents of their own and repeat each other. Texts shorter than a window keep all words; an
empty table gives an empty result; other columns, whatever their names, are left out. A long text makes its batch as long as it is.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, parts_for, pick, shared_dir, text_bytes, written
from .wordhash import WINDOW_BASE, hash_texts, window_hashes

BATCH_BYTES = 4 << 20
#: Bytes of text behind one hash range.
RANGE_BYTES = 16 << 20
#: Bytes of text in a bucket, and the most buckets of a table that Spark takes.
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 100_000
SALTS = 1 << 20
SECOND_BASE = 0xA0761D6478BD642F
_PROBES = "bucket int, batch int, fine binary, low binary"
_WINDOWS = "bucket int, batch int, k1 binary, k2 binary"


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return hash_texts(table.column("text").cast(pa.binary()).to_pylist())


def _long(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Which words belong to a text that has a window at all."""
    n = np.diff(starts)
    return np.repeat(n >= width, n)


def _key47(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(17)


def _emit_probes(ranges: int, width: int, anchor: int):
    def run(table: pa.Table) -> pa.Table:
        h, starts = _words(table)
        probes, first = window_hashes(h, starts, anchor)
        ok = _long(h, starts, width)[first]
        probes, first = probes[ok], first[ok]
        text = np.searchsorted(starts, first, "right") - 1
        block = ((first - starts[text]) % anchor == 0).astype(np.uint64)
        keys = (_key47(probes) << np.uint64(1)) | (block ^ np.uint64(1))  # blocks sort before other probes
        keys.sort()
        same = np.concatenate(([False], keys[1:] >> np.uint64(1) == keys[:-1] >> np.uint64(1)))
        third = np.concatenate((same[:2] & False, same[2:] & same[1:-1])) if len(keys) > 2 else np.zeros(len(keys), bool)
        keys = keys[~third]
        edges = _edges(ranges)
        cuts = np.searchsorted(keys, edges << np.uint64(1))
        cuts[-1] = len(keys)
        out: list[tuple] = []
        batch = table.column("batch")[0].as_py()
        for k in range(ranges):
            own = slice(cuts[k], cuts[k + 1])
            if cuts[k + 1] > cuts[k]:
                out.append((k, batch, *_pack(keys[own])))
        return _rows(out, ["bucket", "batch", "fine", "low"])

    return run


def _edges(ranges: int) -> np.ndarray:
    """Where each range of 47-bit hashes begins; the last ends at 2**47."""
    return np.array([(k << 47) // ranges for k in range(ranges + 1)], np.uint64)


def _pack(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 48-bit numbers as runs (upper 16 bits and how many share them) and lower 32 bits."""
    top = (keys >> np.uint64(32)).astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    runs = np.column_stack([top[cuts], np.diff(np.append(cuts, len(keys)))]).astype(np.uint32)
    return runs.tobytes(), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def _unpack(fine: bytes, low: bytes) -> np.ndarray:
    runs = np.frombuffer(fine, np.uint32).reshape(-1, 2)
    return np.repeat(runs[:, 0].astype(np.uint64), runs[:, 1]) << np.uint64(32) | np.frombuffer(low, np.uint32)


def _rows(out: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "batch": pa.int32()}
    return pa.table({n: pa.array([r[i] for r in out], kinds.get(n, pa.binary())) for i, n in enumerate(names)})


def _match():
    def run(table: pa.Table) -> pa.Table:
        keys, sizes = [], []
        for fine, low in zip(table.column("fine").to_pylist(), table.column("low").to_pylist(), strict=True):
            keys.append(_unpack(fine, low))
            sizes.append(len(keys[-1]))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        names = every[order] >> np.uint64(1)
        new = np.concatenate(([True], names[1:] != names[:-1]))
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(names)))
        block = (every[order[at]] & np.uint64(1)) == 0
        hit = np.empty(len(every), bool)
        hit[order] = ((count >= 2) & block)[group]
        out, pos = [], 0
        for batch, k, n in zip(table.column("batch").to_pylist(), keys, sizes, strict=True):
            found = np.unique(k[hit[pos : pos + n]] >> np.uint64(1))
            pos += n
            if len(found):
                out.append((batch, found.tobytes()))
        return _rows(out, ["batch", "keys"])

    return run


def _hit_windows(h: np.ndarray, starts: np.ndarray, hits: list[bytes], width: int, anchor: int) -> np.ndarray:
    """First words of the windows of width words that hold a hit probe."""
    known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in hits]))
    probes, first = window_hashes(h, starts, anchor)
    keys = _key47(probes)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    flag = np.zeros(len(h) + 1, np.int64)
    flag[first[known[at] == keys] + 1] = 1
    sums = np.cumsum(flag)
    _, windows = window_hashes(h, starts, width)
    return windows[sums[windows + (width - anchor + 1)] - sums[windows] > 0]


def _wide(h: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k1, first = window_hashes(h, starts, width, WINDOW_BASE)
    k2, _ = window_hashes(h, starts, width, SECOND_BASE)
    return k1, (k2 >> np.uint64(32)).astype(np.uint32), first


def _emit_windows(ranges: int, width: int, anchor: int):
    def run(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return _rows([], ["bucket", "batch", "k1", "k2"])
        h, starts = _words(table)
        chosen = _hit_windows(h, starts, hits.column("keys").to_pylist(), width, anchor)
        k1, k2, first = _wide(h, starts, width)
        at = np.searchsorted(first, chosen)
        k1, k2 = k1[at], k2[at]
        order = np.lexsort((k2, k1))
        k1, k2 = k1[order], k2[order]
        keep = np.ones(len(k1), bool)
        keep[2:] = (k1[2:] != k1[:-2]) | (k2[2:] != k2[:-2])
        k1, k2 = k1[keep], k2[keep]
        cuts = np.searchsorted(k1 >> np.uint64(17), _edges(ranges))
        cuts[-1] = len(k1)
        batch = table.column("batch")[0].as_py()
        out = [(k, batch, k1[a:b].tobytes(), k2[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return _rows(out, ["bucket", "batch", "k1", "k2"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one hash range: each batch's window hashes that occur at least twice in all."""
    k1s = [np.frombuffer(x, np.uint64) for x in table.column("k1").to_pylist()]
    k1, k2 = np.concatenate(k1s), np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("k2").to_pylist()])
    order = np.lexsort((k2, k1))
    same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
    many = np.zeros(len(k1), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    out, pos = [], 0
    for batch, own in zip(table.column("batch").to_pylist(), k1s, strict=True):
        mine = slice(pos, pos + len(own))
        pos += len(own)
        if many[mine].any():
            out.append((batch, k1[mine][many[mine]].tobytes(), k2[mine][many[mine]].tobytes()))
    return _rows(out, ["batch", "k1", "k2"])


def _mark(keys: list[str], width: int):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        texts = table.column("text").cast(pa.binary()).to_pylist()
        h, starts = hash_texts(texts)
        cover = np.zeros(len(h) + 1, np.int64)
        if found.num_rows and len(h):
            k1, k2, first = _wide(h, starts, width)
            r1 = np.concatenate([np.frombuffer(x, np.uint64) for x in found.column("k1").to_pylist()])
            r2 = np.concatenate([np.frombuffer(x, np.uint32) for x in found.column("k2").to_pylist()])
            order = np.argsort(r1, kind="stable")
            r1, r2 = r1[order], r2[order]
            lo, hi = np.searchsorted(r1, k1, "left"), np.searchsorted(r1, k1, "right")
            hit = (hi > lo) & (r2[np.minimum(lo, len(r2) - 1)] == k2)
            for i in np.flatnonzero((hi - lo > 1) & ~hit):  # hashes equal in 64 bits only
                hit[i] = (r2[lo[i] : hi[i]] == k2[i]).any()
            at = first[hit]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        out = {k: table.column(k) for k in keys}
        n_words, n_gone, kept, spans = [], [], [], []
        for i, x in enumerate(texts):
            own = gone[starts[i] : starts[i + 1]]
            words = (x or b"").split()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own, [0])).astype(np.int8)))
            n_words.append(len(words))
            n_gone.append(int(own.sum()))
            kept.append(b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g] if n_gone[-1] else words).decode("utf-8", "replace"))
            spans.append([{"first": int(a), "words": int(b - a)} for a, b in edge.reshape(-1, 2)])
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(kept, pa.string())}
        out["repeats"] = pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))
        return pa.table(out)

    return run


def _dealt(docs: DataFrame, key: str, text: str, batches: int, buckets: int) -> DataFrame:
    """docs by batch, as a bucketed table: later passes read a batch together without a shuffle."""
    spark = docs.sparkSession
    name = f"substring_{uuid.uuid4().hex}"
    rows = docs.select(F.pmod(F.xxhash64(F.col(key), F.col(text), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), F.lit(batches)).cast("int").alias("batch"), key, F.col(text).alias("text"))
    rows.repartition(buckets, "batch").write.bucketBy(buckets, "batch").sortBy("batch").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark, name: str) -> None:
    """At the driver's end: the table's entry and files."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, f"{shared_dir(spark)}/{name}")
    except Exception:  # the session has already ended
        return


def remove_repeats(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, kept (the words that stay, joined by one space), repeats (first word and length of each removed run)."""
    docs = pick(docs, key, text)
    anchor = (width + 1) // 2
    total = text_bytes(docs, text)
    batches, ranges = parts_for(total, BATCH_BYTES), parts_for(total, RANGE_BYTES)
    dealt = _dealt(docs, key, text, batches, min(batches, MAX_BUCKETS, parts_for(total, BUCKET_BYTES)))
    probes = dealt.groupBy("batch").applyInArrow(_emit_probes(ranges, width, anchor), _PROBES)
    hits = written(probes.groupBy("bucket").applyInArrow(_match(), "batch int, keys binary"), "hits")
    windows = dealt.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(_emit_windows(ranges, width, anchor), _WINDOWS)
    found = written(windows.groupBy("bucket").applyInArrow(_repeated, "batch int, k1 binary, k2 binary"), "repeats")
    kind = docs.schema[key].dataType.simpleString()
    return dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_mark([key], width), f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string, repeats array<struct<first: int, words: int>>")

"""Benchmark decontamination: BM25 with block-max WAND, then exact overlap of question and answer.

Index: an inverted index over the test items. A posting is the BM25 weight of a term in an item, divided by the
item's score against itself, so 1 is the whole item. Items are numbered by length and cut into blocks of BLOCK; each term has its
largest weight in each block. Queries: every passage of every training text. Passages are windows of 2 * stride words at
every stride, stride being the longest item's words, so any copy of an item lies whole in one. All items whose score reaches
``threshold`` are retrieved: sums of block maxima, taken for many passages at once, drop passages that no block can
serve, and WAND with the same maxima finds the items of the others. A retrieved item counts as leaked if at least
``overlap`` of the word shingles of its question, and of its answer, are in the passage.

Items go to the tasks as one broadcast per shard of at most SHARD_BYTES of item text, whatever their number; a shard holds
indexes of about INDEX_BYTES. Document frequencies and the mean length are those of all items, whatever shard or index an item is in.
Tokens are runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased. Null or tokenless texts and items match
nothing. An item's answer, where the table has no column for it, is its last sentence (last quarter of the words, if there is
one sentence). Parts shorter than a shingle count as one shingle. Rows repeated whole give repeated rows; items that tie in score all count.
Long texts are cut into passages and need memory for their tokens alone. Empty tables give empty results, other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, parts_for, pick, text_bytes, written
from .wordhash import ALNUM, LOWERED, hash_texts, window_hashes

K1, B = 1.2, 0.75
SHARD_BYTES = 16 << 20
INDEX_BYTES = 1 << 16
BLOCK = 4
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item that is one text."""
    parts = [x for x in _SENTENCE.findall(text) if re.search(r"\w", x)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Index:
    """Terms by hash; postings of term t are at first[t]..first[t + 1], items ascending; block_max has a row a term, a column a block of items."""

    ids: list
    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    table: np.ndarray
    parts: list[tuple[tuple[np.ndarray, int], tuple[np.ndarray, int]]]
    stride: int


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return hash_texts([(x or "").encode() for x in texts], ALNUM, LOWERED)


def _shingles(text: str, width: int) -> tuple[np.ndarray, int]:
    """Different shingle hashes, and the shingles' words: all of a part shorter than width."""
    h, starts = _tokens([text])
    width = min(width, len(h))
    return (np.unique(window_hashes(h, starts, width)[0]) if width else np.empty(0, np.uint64)), width


@dataclass
class Statistics:
    """Of all items: their number, their mean length, and the number of items that hold each term (terms sorted by hash)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        h, starts = _tokens(texts)
        pairs = np.unique(np.column_stack([h, np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts))]), axis=0)
        terms, df = np.unique(pairs[:, 0], return_counts=True)
        return Statistics(len(texts), len(h) / max(1, len(texts)), terms, df)


def build_index(rows: list[tuple], width: int, stats: Statistics | None = None) -> Index:
    """rows: (id, question, answer). stats: those of all items, of which rows may be a part."""
    rows = sorted(rows, key=lambda r: len(r[1] or "") + len(r[2] or ""))
    whole = [f"{q or ''}\n{a or ''}" for _, q, a in rows]
    stats = stats or Statistics.of(whole)
    h, starts = _tokens(whole)
    lengths = np.diff(starts)
    item = np.repeat(np.arange(len(rows)), lengths)
    terms, term = np.unique(h, return_inverse=True)
    pairs, tf = np.unique(term * max(1, len(rows)) + item, return_counts=True)
    t, i = pairs // max(1, len(rows)), pairs % max(1, len(rows))
    df = stats.df[np.searchsorted(stats.terms, terms)] if len(terms) else np.zeros(0, np.int64)
    idf = np.log1p((stats.items - df + 0.5) / (df + 0.5))
    weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / max(1.0, stats.mean)))
    own = np.bincount(i, weight, minlength=len(rows))
    weight = weight / own[i]
    first = np.searchsorted(t, np.arange(len(terms) + 1))
    block_max = np.zeros((len(terms), -(-len(rows) // BLOCK)), np.float32)
    np.maximum.at(block_max, (t, i // BLOCK), np.nextafter(weight.astype(np.float32), np.float32(2)))
    table = np.full(1 << max(10, (4 * len(terms)).bit_length()), -1, np.int32)
    slot = (terms & np.uint64(len(table) - 1)).astype(np.int64)
    for k in range(len(terms)):  # open addressing
        s = slot[k]
        while table[s] >= 0:
            s = (s + 1) % len(table)
        table[s] = k
    return Index(
        [r[0] for r in rows], terms, first, i, weight, block_max, block_max.max(axis=1, initial=0), table,
        [(_shingles(q or "", width), _shingles(a or "", width)) for _, q, a in rows], int(max(lengths.max(initial=1), 1)),
    )


def look_up(index: Index, h: np.ndarray) -> np.ndarray:
    """Term numbers of hashes, -1 for others."""
    out = np.full(len(h), -1, np.int32)
    slot = (h & np.uint64(len(index.table) - 1)).astype(np.int64)
    at = np.arange(len(h))
    while len(at):
        term = index.table[slot[at]]
        filled = term >= 0
        at, term = at[filled], term[filled]
        same = index.terms[term] == h[at]
        out[at[same]] = term[same]
        at = at[~same]
        slot[at] = (slot[at] + 1) % len(index.table)
    return out


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items whose summed weight over the different terms reaches the threshold, by block-max WAND."""
    pos = {t: int(index.first[t]) for t in terms.tolist()}
    end = {t: int(index.first[t + 1]) for t in pos}
    out = []
    items, first, maxima = index.items, index.first, index.term_max
    live = sorted(pos, key=lambda t: items[pos[t]])
    while live:
        bound, pivot = 0.0, -1
        for k, t in enumerate(live):
            bound += maxima[t]
            if bound >= threshold - 1e-9:
                pivot = k
                break
        if pivot < 0:
            return out
        item = items[pos[live[pivot]]]
        while pivot + 1 < len(live) and items[pos[live[pivot + 1]]] == item:
            pivot += 1
        head = live[: pivot + 1]
        block = int(item) // BLOCK
        bound = sum(float(index.block_max[t, block]) for t in head)
        if bound >= threshold - 1e-9:
            score = 0.0
            for t in head:
                p = pos[t] + int(np.searchsorted(items[pos[t] : end[t]], item))
                if p < end[t] and items[p] == item:
                    score += index.weights[p]
                    p += 1
                pos[t] = p
            if score >= threshold - 1e-9:
                out.append((int(item), float(score)))
        else:
            after = (block + 1) * BLOCK
            if pivot + 1 < len(live):
                after = min(after, int(items[pos[live[pivot + 1]]]))
            after = max(after, int(item) + 1)
            for t in head:
                pos[t] += int(np.searchsorted(items[pos[t] : end[t]], after))
        live = sorted((t for t in live if pos[t] < end[t]), key=lambda t: items[pos[t]])
    return out


def _likely(index: Index, term: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Passages that some block's maxima let reach the threshold: their text, first and end word, and different known terms."""
    lengths = np.diff(starts)
    n = np.maximum(1, -(-lengths // index.stride) - 1) * (lengths > 0)  # passages of a text
    before = np.cumsum(n) - n
    at = np.flatnonzero(term >= 0)
    doc = np.searchsorted(starts, at, "right") - 1
    segment = (at - starts[doc]) // index.stride
    both = [(ok := (number >= 0) & (number < n[doc]), (before[doc] + number)[ok], term[at][ok]) for number in (segment, segment - 1)]
    pairs = np.unique(np.concatenate([w * len(index.terms) + t for _, w, t in both]))
    window, own = pairs // len(index.terms), pairs % len(index.terms)
    windows, first = np.unique(window, return_index=True)
    if not len(windows):
        return (np.empty(0, np.int64),) * 3 + ([],)
    reach = (np.add.reduceat(index.block_max[own], first, axis=0) >= threshold - 1e-5).any(axis=1)
    ends = np.append(first[1:], len(own))
    chosen = windows[reach]
    doc = np.searchsorted(before + n, chosen, "right")
    a = starts[doc] + (chosen - before[doc]) * index.stride
    return doc, a, np.minimum(a + 2 * index.stride, starts[doc + 1]), [own[x:y] for x, y in zip(first[reach], ends[reach], strict=True)]


def leaks(index: Index, h: np.ndarray, starts: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, dict]]:
    """(text number, leaked item) with the best passage's score and overlaps, for texts given as token hashes."""
    if not len(index.terms) or not len(h):
        return []
    doc, a, z, terms = _likely(index, look_up(index, h).astype(np.int64), starts, threshold)
    best: dict[tuple[int, int], dict] = {}
    for k in range(len(doc)):
        hits = wand(index, terms[k], threshold)
        if not hits:
            continue
        words = h[a[k] : z[k]]
        have: dict[int, np.ndarray] = {}
        for item, score in hits:
            shares = []
            for part, w in index.parts[item]:
                if not w:
                    shares.append(None)
                    continue
                if w not in have:
                    have[w] = window_hashes(words, np.array([0, len(words)]), w)[0]
                shares.append(float(np.isin(part, have[w]).mean()))
            if all(s is None or s >= overlap for s in shares):
                old = best.get((int(doc[k]), item))
                if old is None or score > old["score"]:
                    best[int(doc[k]), item] = {"item_id": index.ids[item], "score": score, "question": shares[0], "answer": shares[1]}
    return [(d, row) for (d, _), row in best.items()]


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """key, item_id, score, question_overlap, answer_overlap: a row for every leaked item of every text."""
    docs = pick(docs, key, text)
    out = None
    for shared, kind in _shards(items, width, item_key, question, answer):
        found = _scan(docs, shared, threshold, overlap, key, text, item_key, kind)
        out = found if out is None else out.unionByName(found)
    return out


def count_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.8, width: int = 5, text: str = "text", item_key: str = "item_id", question: str = "text", answer: str | None = None, out: str = "leaks") -> DataFrame:
    """docs with one more column, the number of items that leaked into the row's text; no shuffle."""
    total = None
    for shared, _ in _shards(items, width, item_key, question, answer):
        def make(shared=shared):
            def f(texts, _):
                n = np.zeros(len(texts), np.int64)
                for at in range(0, len(texts), 512):
                    h, starts = hash_texts(texts[at : at + 512], ALNUM, LOWERED)
                    for index in shared.value:
                        np.add.at(n, [at + i for i, _ in leaks(index, h, starts, threshold, overlap)], 1)
                return {"_n": n}

            return f

        docs = map_text(docs, "_n bigint", make, text, keep_text=True)
        total = F.col("_n") if total is None else F.col(out) + F.col("_n")
        docs = docs.withColumn(out, total).drop("_n")
    return docs


def _shards(items: DataFrame, width: int, item_key: str, question: str, answer: str | None):
    """Broadcast indexes of each shard, and the type of the item key."""
    names = [item_key, question] + ([answer] if answer else [])
    items = pick(items, *names)
    spark = items.sparkSession
    shards = parts_for(text_bytes(items, question) + (text_bytes(items, answer) if answer else 0), SHARD_BYTES)
    shard = F.pmod(F.xxhash64(*names), F.lit(shards)).cast("int")
    kind = items.schema[item_key].dataType.simpleString()

    def terms(batches):
        for b in batches:
            shard, *texts = (c.to_pylist() for c in b.columns)
            for s, q, *a in zip(shard, *texts, strict=True):
                h, _ = _tokens(["\n".join((q or "", a[0] or "")) if answer else "\n".join(split_item(q or ""))])
                found = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found) + 1, s, np.int32)), pa.array([*found.tolist(), None], pa.int64()), pa.array([0] * len(found) + [len(h)], pa.int64())], names=["shard", "h", "length"])

    # an item's row without a term has its length; what the driver gets of terms is what the shard's items hold
    held = written(items.select(shard.alias("shard"), *names[1:]).mapInArrow(terms, "shard int, h bigint, length bigint"), "terms")
    n, mean = held.filter("h IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    df = held.filter("h IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    known = written(held.filter("h IS NOT NULL").select("shard", "h").distinct().join(df, "h"), "frequencies")
    for s in range(shards):
        rows = items.filter(shard == s).collect()  # bounded by SHARD_BYTES
        rows = [(r[0], *((r[1], r[2]) if answer else split_item(r[1] or ""))) for r in rows]
        rows.sort(key=lambda r: (len(r[1] or "") + len(r[2] or ""), r[0] is None, r[0]))
        own = known.filter(F.col("shard") == s).select("h", "df").toArrow()
        h, count = own["h"].to_numpy().astype(np.int64).view(np.uint64), own["df"].to_numpy().astype(np.int64)
        order = np.argsort(h)
        stats = Statistics(n, mean, h[order], count[order])
        # items of like length share an index, so that a long one makes no passage of short ones long
        parts = parts_for(sum(len(q or "") + len(a or "") for _, q, a in rows), INDEX_BYTES)
        edges = [len(rows) * k // parts for k in range(parts + 1)]
        yield spark.sparkContext.broadcast([build_index(rows[a:b], width, stats) for a, b in zip(edges, edges[1:], strict=False)]), kind


def _scan(docs: DataFrame, shared, threshold: float, overlap: float, key: str, text: str, item_key: str, kind: str) -> DataFrame:
    def run(batches):
        indexes = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 512):
                h, starts = hash_texts(texts[at : at + 512], ALNUM, LOWERED)
                flat = [(at + i, row) for index in indexes for i, row in leaks(index, h, starts, threshold, overlap)]
                if flat:
                    keys = b.column(b.schema.get_field_index(key)).take(pa.array([i for i, _ in flat]))
                    cols = [pa.array([r[c] for _, r in flat]) for c in ("item_id",)] + [pa.array([r[c] for _, r in flat], pa.float64()) for c in ("score", "question", "answer")]
                    yield pa.RecordBatch.from_arrays([keys, *cols], names=[key, item_key, "score", "question_overlap", "answer_overlap"])

    own = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {own}, `{item_key}` {kind}, score double, question_overlap double, answer_overlap double")

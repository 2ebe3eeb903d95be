"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are words, A-Z lower-cased, and one end a text. Symbols of the model are the SYMBOLS most frequent tokens and CLASSES
classes of all others by how frequent they are: bands of ranks, each twice as long as the one before, and one class of all that is rarer than
the NEAR most frequent or unseen; a token outside the symbols has its class's probability times its own
smoothed share of the class, so a text's probability is over all tokens and sums to one. The model predicts a
symbol from the one before: exp(R[u] C . Q[v] + b[v]), normalised over all symbols by one
matrix product for all contexts.

Corpus statistics cover every training row: the counts of all tokens, a table that grows with the corpus, and counts of neighbouring symbols, which are all
the model learns from. There are at most the square of the number of symbols of the latter; training makes EPOCHS passes over as many pairs as were
found different, so steps follow what the corpus holds until all pairs have been seen. Tokens beyond the
NEAR most frequent are looked up by a join; none of them is frequent enough to be a hot key. A token is
known by a 64-bit hash.

A null text is empty: its end token alone. With nothing to learn from, counts are zero and the model is uniform. Rows repeated whole each get a row
(the join is by partition and row number); equally frequent tokens rank by hash; an empty table gives an empty result; other columns, whatever
their names, are left out. A long text goes through in blocks and needs memory for its token hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, pick, written
from .wordhash import LOWERED, WORDS, hash_texts

SYMBOLS = 2032
NEAR = 1 << 17
#: Bands of ranks from SYMBOLS to NEAR, and the class of all other tokens.
CLASSES = 8
DIM = 48
NOISE = 256
#: Steps at least, and draws for each different pair.
STEPS = 1500
EPOCHS = 1.0
BATCH = 1024
SEED = 97
END = np.uint64(0x0123456789ABCDEF)
GROUP = 512


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after every text, and where each text starts."""
    h, starts = hash_texts(texts, WORDS, LOWERED)
    n = np.arange(len(texts))
    out = np.full(len(h) + len(texts), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[starts[1:] + n] = False
    out[keep] = h
    return out, starts + np.arange(len(starts))


@dataclass
class Counts:
    """Bounded parts of the corpus counts: the NEAR most frequent tokens (sorted by hash) with their symbol or class, and totals by class for tokens outside the symbols."""

    total: int
    distinct: int
    near: np.ndarray
    near_count: np.ndarray
    symbols: int
    symbol_of: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol or class number (the last is that of tokens outside near), count, and whether the token is in near."""
        rest = self.symbols + CLASSES - 1
        if not len(self.near):
            return np.full(len(h), rest), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.near, h), len(self.near) - 1)
        known = self.near[at] == h
        return np.where(known, self.symbol_of[at], rest), np.where(known, self.near_count[at], 0), known


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """h (the hash as a signed number) and c over all rows of docs."""

    def run(batches):
        for b in batches:
            h, c = np.unique(tokens(b.column(0).cast(pa.binary()).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return pick(docs, text).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def bounded_counts(counts: DataFrame, symbols: int = SYMBOLS, near: int = NEAR) -> Counts:
    # the largest share of the most frequent tokens that fits: by a histogram of counts, not by a sort that every task answers in full
    level = F.floor(F.log2("c") * 8)
    hist = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    least, size = None, 0
    for r in sorted(hist, key=lambda r: -r["level"]):
        size += r["n"]
        if size > near:
            break
        least = r["least"]
    top = counts.filter(F.col("c") >= least if least is not None else F.lit(False)).toArrow()
    h, c = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    rank = np.arange(len(h))
    own = min(symbols, len(h))
    band = np.minimum(np.log2(rank // max(1, symbols) + 1e-9).astype(np.int64).clip(0), CLASSES - 2)
    number = np.where(rank < own, rank, own + band)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (np.bincount(band[own:], w, CLASSES).astype(np.int64) for w in (c[own:], None))
    total[-1], distinct[-1] = whole["c"] - c.sum(), whole["v"] - len(h)
    order = np.argsort(h)
    return Counts(whole["c"], whole["v"], h[order], c[order], own, number[order], total, distinct)


def count_pairs(docs: DataFrame, counts: Counts, text: str = "text") -> DataFrame:
    """pair (number of the earlier symbol * all symbols + the later one) and n; a text begins after an end."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    size = counts.symbols + CLASSES

    def run(batches):
        counts = shared.value
        table = np.zeros(size * size, np.int64)
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), GROUP):
                symbol, _, _ = counts.look_up(tokens(texts[at : at + GROUP])[0])
                end = counts.look_up(np.array([END]))[0]
                found, n = np.unique(np.concatenate((end, symbol[:-1])) * size + symbol, return_counts=True)
                table[found] += n
        found = np.flatnonzero(table)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], names=["pair", "n"])

    return pick(docs, text).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def log_probabilities(self) -> np.ndarray:
        """log10 of P(later | earlier) for all pairs of symbols."""
        s = (self.r @ self.c) @ self.q.T + self.b
        s -= s.max(axis=1, keepdims=True)
        return ((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


def train(pair: np.ndarray, n: np.ndarray, size: int, steps: int = STEPS, rate: float = 0.1) -> Model:
    """Noise-contrastive estimation with Adagrad; noise is drawn from the smoothed unigram and shared by a batch."""
    rng = np.random.default_rng(SEED)
    order = np.argsort(pair)
    u, v, n = (pair[order] // size).astype(np.int32), (pair[order] % size).astype(np.int32), n[order].astype(np.float64)
    unigram = np.bincount(v, n, minlength=size) + 0.5
    unigram /= unigram.sum()
    model = Model(rng.standard_normal((size, DIM)) * 0.1, np.eye(DIM), np.zeros((size, DIM)), np.log(unigram))
    if not len(n):
        return model
    ends, noise_ends = np.cumsum(n), np.cumsum(unigram)
    log_noise = np.log(NOISE * unigram)
    params = [model.r, model.c, model.q, model.b]
    past = [np.full_like(p, 1e-2) for p in params]
    for step in range(steps):
        i = np.searchsorted(ends, rng.random(BATCH) * ends[-1], "right").clip(max=len(n) - 1)
        a, t = u[i], v[i]
        z = np.searchsorted(noise_ends, rng.random(NOISE), "right").clip(max=size - 1)
        pred = model.r[a] @ model.c
        data = 1 / (1 + np.exp(np.clip((pred * model.q[t]).sum(axis=1) + model.b[t] - log_noise[t], -30, 30)))
        fake = -1 / (1 + np.exp(-np.clip(pred @ model.q[z].T + model.b[z] - log_noise[z], -30, 30)))
        data, fake = data / BATCH, fake / BATCH
        back = data[:, None] * model.q[t] + fake @ model.q[z]
        grads = [np.zeros_like(p) for p in params]
        np.add.at(grads[0], a, back @ model.c.T)
        grads[1] = model.r[a].T @ back
        np.add.at(grads[2], t, data[:, None] * pred)
        np.add.at(grads[2], z, fake.T @ pred)
        grads[3] = np.bincount(t, data, minlength=size) + np.bincount(z, fake.sum(axis=0), minlength=size)
        pace = rate * (1 - step / steps)
        for p, g, h in zip(params, grads, past, strict=True):
            g *= BATCH**0.5
            h += g * g
            p += pace * g / np.sqrt(h)
    return model


def _known_part(docs: DataFrame, counts: Counts, model: Model, key: tuple[str, ...], text: str) -> DataFrame:
    """Per row: key columns, sums over the tokens in near and the model's part for all; other tokens as packed lists."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, model))

    def make():
        counts, model = shared.value
        table = model.log_probabilities()
        row = TaskContext.get().partitionId() << 40

        def f(texts, _):
            cols: dict[str, list] = {k: [] for k in ("n_tokens", "n_near", "base", "lm")}
            far, times, sizes = [], [], []
            for at in range(0, len(texts), GROUP):
                h, starts = tokens(texts[at : at + GROUP])
                symbol, c, known = counts.look_up(h)
                before = np.concatenate((counts.look_up(np.array([END]))[0], symbol[:-1]))
                k = np.maximum(symbol - counts.symbols, 0)
                rare = symbol >= counts.symbols
                share = np.log10((c + 0.5) / (counts.class_total[k] + 0.5 * (counts.class_distinct[k] + 1)))
                first = starts[:-1]
                cols["n_tokens"].append(np.diff(starts))
                cols["n_near"].append(np.add.reduceat(known.astype(np.int64), first))
                cols["base"].append(np.add.reduceat(np.where(known, counts.base(c), 0.0), first))
                cols["lm"].append(np.add.reduceat(table[before, symbol] + np.where(rare & known, share, 0.0), first))
                text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[~known]
                order = np.lexsort((h[~known], text))
                text, other = text[order], h[~known][order]
                new = np.ones(len(other), bool)
                new[1:] = (other[1:] != other[:-1]) | (text[1:] != text[:-1])
                where = np.flatnonzero(new)
                far.append(other[where])
                times.append(np.diff(np.append(where, len(other))))
                sizes.append(np.bincount(text[where], minlength=len(starts) - 1))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), pa.int32())
            out = {k: pa.array(np.concatenate(v)) for k, v in cols.items()}
            out["far"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(far).view(np.int64)))
            out["times"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times).astype(np.int32)))
            nonlocal row
            out["row"] = pa.array(row + np.arange(len(texts)))
            row += len(texts)
            return out

        return f

    return map_text(pick(docs, *key, text), "n_tokens bigint, n_near bigint, base double, lm double, far array<bigint>, times array<int>, row bigint", make, text)


def score_texts(docs: DataFrame, learn: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text", symbols: int = SYMBOLS, near: int = NEAR, steps: int = STEPS) -> DataFrame:
    """Per row of docs: key columns, n_tokens, n_known (seen in learn), train_tokens, base_score, score (both log10). learn: the rows to learn from."""
    table = written(count_tokens(learn, text), "counts")
    counts = bounded_counts(table, symbols, near)
    pairs = count_pairs(learn, counts, text).toArrow()  # at most the square of the number of symbols
    model = train(pairs["pair"].to_numpy(), pairs["n"].to_numpy(), counts.symbols + CLASSES, max(steps, int(EPOCHS * pairs.num_rows) // BATCH))
    del pairs
    rows = written(_known_part(docs, counts, model, key, text), "scored")
    far = rows.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("h"), F.col("x.times").alias("n"))
    found = far.join(table, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = float(counts.class_total[-1] + 0.5 * (counts.class_distinct[-1] + 1))
    whole = counts.total + 0.5 * (counts.distinct + 1)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(whole))).alias("far_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(rest))).alias("far_lm"),
    )
    none = F.lit(0.0)
    return rows.join(sums, "row", "left").select(
        *key, "n_tokens", (F.col("n_near") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("far_base", none)).alias("base_score"), (F.col("lm") + F.coalesce("far_lm", none)).alias("score"),
    )

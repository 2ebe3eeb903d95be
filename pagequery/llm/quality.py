"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters, of digits or of other marks, hashed to BUCKETS; each bucket has a sparse random index vector, and its
word vector is the sum of the index vectors that stand within WINDOW tokens of it anywhere in the corpus. Partial sums are
packed by task and added up in blocks, so what moves and what the driver gets is BUCKETS * DIM numbers, whatever the corpus. A
document's features are the mean of its tokens' unit vectors, their spread, and the mean product of neighbours. The network is
trained on the driver from at most MAX_LABELLED labelled rows (chosen by hash, a parameter);
a temperature fitted on rows held back from training calibrates its probabilities.

Null and empty texts have the zero features of no token and get the network's answer for them. Rows without a label,
or with one that is neither 0 nor 1, teach nothing; with no labelled row of both kinds every score is the share of label 1 (0.5 for none).
Tokens are pooled CHUNK at a time, so a worker's memory holds a long text and its token numbers, never its vectors. Rows repeated whole get
equal scores; repeats of a labelled id count as one row (the largest label, the smallest features). Other columns of docs, whatever their names, are left out;
an empty table gives an empty result. Equal texts tie: they have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, pick
from .wordhash import TOKENS, hash_texts

BUCKETS = 1 << 13
DIM = 64
NONZERO = 2
WINDOW = 2
HIDDEN = 32
#: Features a document.
POOLED = 3 * DIM
MAX_LABELLED = 20_000
SEED = 1234567
#: Word vectors that one packed block holds.
BLOCK_ROWS = 512
#: Tokens that are pooled, and whose neighbours are counted, at once.
CHUNK = 2048
CONTEXTS = 1 << 18


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def buckets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    h, starts = hash_texts(texts, TOKENS)
    return (h % np.uint64(BUCKETS)).astype(np.int64), starts


def add_contexts(bucket: np.ndarray, starts: np.ndarray, sums: np.ndarray) -> None:
    """Adds to sums (BUCKETS * DIM) what neighbours within one text give."""
    place, sign = _index_vectors()
    for at in range(0, len(bucket), CONTEXTS):
        own = bucket[at : at + CONTEXTS + WINDOW]
        text = np.searchsorted(starts, np.arange(at, at + len(own)), "right")
        pairs = np.zeros(0, np.int64)
        for lag in range(1, WINDOW + 1):
            a, b, ok = own[:-lag][:CONTEXTS], own[lag:][:CONTEXTS], (text[lag:] == text[:-lag])[:CONTEXTS]
            pairs = np.concatenate((pairs, a[ok] * BUCKETS + b[ok], b[ok] * BUCKETS + a[ok]))
        pairs, n = np.unique(pairs, return_counts=True)
        word, other = pairs // BUCKETS, pairs % BUCKETS
        for k in range(NONZERO):
            sums += np.bincount(word * DIM + place[other, k], n * sign[other, k], minlength=len(sums)).astype(np.int64)


def pack(sums: np.ndarray) -> bytes:
    """A width byte, then numbers of the narrowest type that holds all."""
    top = int(np.abs(sums).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + sums.astype(f"<i{width}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets, over every row of docs; rows of buckets never seen are zero."""

    def partial(batches):
        sums = np.zeros(BUCKETS * DIM, np.int64)
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 512):
                add_contexts(*buckets_of(texts[at : at + 512]), sums)
        for k in range(BUCKETS // BLOCK_ROWS):
            own = sums[k * BLOCK_ROWS * DIM : (k + 1) * BLOCK_ROWS * DIM]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(own)])], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK_ROWS * DIM, np.int64)
        for x in table.column("sums").to_pylist():
            total += unpack(x)
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([pack(total)])})

    schema = "block int, sums binary"
    parts = pick(docs, text).filter(F.col(text).isNotNull()).mapInArrow(partial, schema)
    # two steps, so that a block's parts never meet in one group in full
    some = parts.withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(64))).groupBy("block", "part").applyInArrow(add, schema)
    out = np.zeros((BUCKETS, DIM))
    for r in some.groupBy("block").applyInArrow(add, schema).collect():
        out[r["block"] * BLOCK_ROWS : (r["block"] + 1) * BLOCK_ROWS] = unpack(r["sums"]).reshape(-1, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


def pool(bucket: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row a text: mean and standard deviation of its tokens' vectors, and the mean product of each with the next."""
    out = np.zeros((len(starts) - 1, POOLED), np.float64)
    n = np.diff(starts)
    some = np.flatnonzero(n)
    first, last = starts[some], starts[some + 1] - 1
    for at in range(0, len(bucket), CHUNK):  # few enough tokens for their vectors to stay in the cache
        v = vectors[bucket[at : at + CHUNK + 1]]
        next_to = v[:CHUNK].copy()
        next_to[: len(v) - 1] *= v[1:]
        v = v[:CHUNK]
        a, z = np.searchsorted(last, at), np.searchsorted(first, at + len(v))
        ends = last[a:z] - at
        next_to[ends[ends < len(v)]] = 0  # a text's last token has no next
        cuts, rows = np.maximum(first[a:z] - at, 0), some[a:z]
        out[rows, :DIM] += np.add.reduceat(v, cuts, axis=0)
        out[rows, 2 * DIM :] += np.add.reduceat(next_to, cuts, axis=0)
        np.square(v, out=next_to)
        out[rows, DIM : 2 * DIM] += np.add.reduceat(next_to, cuts, axis=0)
    if len(some):
        mean = out[some, :DIM] / n[some, None]
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(out[some, DIM : 2 * DIM] / n[some, None] - mean**2, 0))
        out[some, 2 * DIM :] /= np.maximum(n[some, None] - 1, 1)
        out[some, :DIM] = mean
    return out.astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """Key columns and f, the packed pooled features."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors.astype(np.float32))

    def make():
        vectors = shared.value

        def f(texts, _):
            rows = []
            for at in range(0, len(texts), 256):
                rows.append(pool(*buckets_of(texts[at : at + 256]), vectors))
            return {"f": pa.array([r.tobytes() for x in rows for r in x], pa.binary())}

        return f

    return map_text(pick(docs, *key, text), "f binary", make, text)


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, batch: int = 128) -> Network:
    """Adam on the log loss; every tenth row is held back for the temperature."""
    rng = np.random.default_rng(SEED)
    share = float(y.mean()) if len(y) else 0.5
    shift, scale = (x.mean(axis=0), 1 / (x.std(axis=0) + 1e-3)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(shift, scale, np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(y) < 2 or share in (0.0, 1.0):
        return net
    net.w1, net.w2 = rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)
    order = rng.permutation(len(y))
    held, own = (order[::10], np.setdiff1d(order, order[::10])) if len(y) >= 50 else (order, order)
    z = (x - shift) * scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        mixed = rng.permutation(own)
        for at in range(0, len(mixed), batch):
            i = mixed[at : at + batch]
            hidden = np.tanh(z[i] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(err, params[2]) * (1 - hidden**2)
            grads = [z[i].T @ back + decay * params[0], back.sum(axis=0), hidden.T @ err + decay * params[2], np.array([err.sum()])]
            t += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    net.temperature = float(min(grid, key=lambda g: np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / g).mean()))
    return net


def sample_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """key and y of at most max_labelled rows, chosen by hash; repeats of a key count once, the larger label holds."""
    marks = pick(labels, key, label).filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    share = min(1.0, 0.9 * max_labelled / max(1, marks.count()))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    return marks.filter(place < share).limit(max_labelled)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Network:
    """Features leave the tasks for the sampled rows alone: their ids, at most max_labelled, are broadcast, and a row an id comes back."""
    marks = sample_labels(labels, key, label, max_labelled)
    rows = pick(docs, key, text).join(F.broadcast(marks), key).select(F.col(key).alias("_k"), "y", text)
    sample = features(rows, vectors, ("_k", "y"), text).groupBy("_k").agg(F.max("y").alias("y"), F.min("f").alias("f")).select("y", "f").collect()
    sample.sort(key=lambda r: (bytes(r["f"]), r["y"]))
    x = np.array([np.frombuffer(r["f"], np.float32) for r in sample], np.float64).reshape(len(sample), POOLED)
    return train(x, np.array([r["y"] for r in sample], np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """Key columns and score."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors.astype(np.float32), net))

    def make():
        vectors, net = shared.value

        def f(texts, _):
            parts = [net.probabilities(pool(*buckets_of(texts[at : at + 256]), vectors).astype(np.float64)) for at in range(0, len(texts), 256)]
            return {"score": pa.array(np.concatenate(parts))}

        return f

    return map_text(pick(docs, *key, text), "score double", make, text)


def classify(docs: DataFrame, labels: DataFrame, key: tuple[str, ...] = ("doc_id",), text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of docs: key columns and score. labels: the rows that may be learned from, by the first key column."""
    vectors = word_vectors(docs, text)
    net = fit(docs, labels, vectors, key[0], text, label, max_labelled)
    return score(docs, vectors, net, key, text)

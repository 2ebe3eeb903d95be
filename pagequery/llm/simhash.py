"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: XXH64 of every word shingle, a bit is 1 if more than half of the hashes set it.
Equal fingerprints collapse first. Distinct ones that differ in at most ``radius`` bits agree on at least one of
radius + 1 fixed bit blocks, so comparing within equal blocks loses no link. A block's
fingerprints are compared as tiles: exclusive-or and bit counts in numpy, sorted by population count, tile pairs whose
counts differ by more than the radius skipped. A block value with more than TILE fingerprints is cut into tiles that go to
different tasks, each pair of tiles once. A tile pair returns a spanning forest of its links, never
all of them; components are then joined up by components().

Wider fingerprints (``words`` > 1) serve lower similarities: further words come from the same shingle hashes, mixed with other
constants. At a radius of a sixth of all bits no cut into blocks is lossless, so BLOCKS * words blocks of BLOCK_BITS bits are
used: two texts whose bits differ with probability p share a block with probability about
1 - (1 - (1 - p) ** BLOCK_BITS) ** blocks, 0.998 at 256 bits and a shingle similarity of 0.8, and more above.

With ``alike`` links are candidates only. Nodes are then distinct shingle sets, and the sets of each candidate component are
compared exactly; only pairs whose similarity (common shingles by all shingles) is at least alike link. A component of
more than UNIT sets is dealt out: first each part is compared with itself and a few pivots, which joins up most of a
group of copies; then tiles of what the largest joined group lacks meet all tiles.

Null and blank texts have fingerprint zero and link like any other. Rows repeated whole stay as rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, pick, written
from .components import components
from .wordhash import mix

SEED = 42
TILE = 4096
#: Rows of one numpy comparison.
CHUNK = 512
BLOCK_BITS = 10
#: Blocks of each word of a wider fingerprint.
BLOCKS = 8
#: Shingle sets of one exact comparison, and those of a larger component that all its parts meet.
UNIT = 512
PIVOTS = 16
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """XXH64 of each shingle; of the whole sequence if there are fewer words, none for no words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:z], SEED) for a, z in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fold_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes: the majority of every bit, ties 0, no hashes 0."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    segments = (n + 254) // 255  # sums of bytes stay below 256
    first = np.concatenate(([0], np.cumsum(segments)[:-1]))
    at = np.repeat(starts - first * 255, segments) + np.arange(segments.sum()) * 255
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (2 * sums[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def wide_bits(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """A row of words fingerprints for each run of hashes."""
    with np.errstate(over="ignore"):
        each = [hashes] + [mix(hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)) for k in range(1, words)]
    return np.column_stack([fold_bits(h, counts) for h in each])


def blocks_of(bits: np.ndarray) -> np.ndarray:
    """Numbers of the blocks of each row: place and value in one."""
    flat = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")
    n, each = bits.shape[1] * BLOCKS, flat.shape[1] // BLOCK_BITS
    rng = np.random.default_rng(SEED)
    deals = [np.arange(flat.shape[1])] + [rng.permutation(flat.shape[1]) for _ in range((n - 1) // each)]
    order = np.concatenate([d[: each * BLOCK_BITS] for d in deals])[: n * BLOCK_BITS]
    values = flat[:, order].reshape(len(bits), n, BLOCK_BITS) @ (1 << np.arange(BLOCK_BITS))
    return values + (np.arange(n) << BLOCK_BITS)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def fingerprints(docs: DataFrame, width: int, key: tuple[str, ...] = ("doc_id",), text: str = "text", words: int = 1, sets: bool = False) -> DataFrame:
    """Key columns and fp, the fingerprint as a signed 64-bit number; for more words fp is a hash of all, and bits holds them.

    With sets a repeated shingle counts once, and fp is a hash of the shingle set.
    """

    def make():
        def f(texts, _):
            out, names = [], []
            for at in range(0, len(texts), 256):
                each = [shingle_set(x, width) if sets else shingle_hashes(x, width) for x in texts[at : at + 256]]
                names += [set_hash(x) for x in each] if sets else []
                counts = np.array([len(x) for x in each], np.int64)
                out.append(wide_bits(np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum())), counts, words))
            bits = np.concatenate(out)
            if words == 1 and not sets:
                return {"fp": pa.array(bits[:, 0].view(np.int64))}
            packed = [r.tobytes() for r in bits]
            names = names or [xxhash.xxh64_intdigest(x, SEED) for x in packed]
            return {"fp": pa.array(np.array(names, np.uint64).view(np.int64)), "bits": pa.array(packed, pa.binary())}

        return f

    return map_text(pick(docs, *key, text), "fp bigint" + (", bits binary" if words > 1 else ""), make, text)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For links i-j over n nodes, the smallest node that each one reaches."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds a fingerprint's words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def close_pairs(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links within one unit, a spanning set: side 2 compares with all of side 2, side 0 with side 1 only."""
    weight = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(weight, kind="stable")
    fp, side, weight = fp[order], side[order], weight[order]
    label = np.arange(len(fp))
    for a in range(0, len(fp), CHUNK):
        for b in range(a, len(fp), CHUNK):
            if weight[b] - weight[min(a + CHUNK, len(fp)) - 1] > radius:
                break
            near = distance(fp[a : a + CHUNK, None], fp[None, b : b + CHUNK]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            ok = (i < j) & ((side[i] == 2) | (side[i] != side[j])) & (label[i] != label[j])
            if ok.any():
                label = forest(len(fp), np.concatenate((np.arange(len(fp)), i[ok])), np.concatenate((label, j[ok])))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return order[moved], order[label[moved]]


def _compare(radius: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate(([0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, [len(rows)]))
            sizes = np.diff(cuts)
            found = [(np.empty(0, np.int64),) * 2]
            for k in np.flatnonzero(sizes > 1):
                own = slice(cuts[k], cuts[k + 1])
                found.append(tuple(x + cuts[k] for x in close_pairs(bits[own], rows[own, 3], radius)))
            u, v = (rows[np.concatenate([x[s] for x in found]), 4] for s in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)])
            bits = np.ascontiguousarray(rows[:, 4:5]).view(np.uint64) if words == 1 else np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(-1, words)
            if held:
                rows, bits = np.concatenate([held[0], rows]), np.concatenate([held[1], bits])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [rows[cut:], bits[cut:]]
            if cut:
                yield links(rows[:cut], bits[:cut])
        if held and len(held[0]):
            yield links(*held)

    return run


def _lossless_blocks(nodes: DataFrame, radius: int) -> DataFrame:
    """A row for each of radius + 1 blocks of each fingerprint: g (block and its value), w (bits set), fp."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("x") for a, b in zip(edges, edges[1:], strict=False)]
    wide = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    rows = nodes.select("fp", F.bit_count("fp").alias("w"), F.posexplode(F.array(*blocks)).alias("k", "x"))
    return rows.select((F.shiftleft("k", wide).cast("long") + F.col("x")).alias("g"), "w", "fp")


def _wide_blocks(nodes: DataFrame) -> DataFrame:
    """The same for wider fingerprints, with their bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).to_pylist()
            bits = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
            blocks = blocks_of(bits)
            ends = pa.array(np.arange(len(raw) + 1) * blocks.shape[1], pa.int32())
            weight = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weight.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(blocks.ravel()))], names=["fp", "bits", "w", "blocks"])

    rows = nodes.select("fp", "bits").mapInArrow(run, "fp bigint, bits binary, w int, blocks array<bigint>")
    return rows.select(F.explode("blocks").alias("g"), "w", "fp", "bits")


def links(nodes: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """nodes: distinct fp (and bits, for more words than one) -> links (u, v) that span the pairs within radius."""
    rows = _lossless_blocks(nodes, radius) if words == 1 else _wide_blocks(nodes)
    more = [] if words == 1 else ["bits"]
    counts = rows.groupBy("g", "w").agg(F.count(F.lit(1)).alias("c"))
    # at most a row for each value that a block can have: 2**13 times 5, or 2**10 times BLOCKS * words; small enough to broadcast
    hot = written(counts.groupBy("g").agg(F.sum("c").alias("n")).filter(F.col("n") > TILE).select("g"), "hot")
    tiles = counts.join(F.broadcast(hot), "g").select("g", "w", F.ceil(F.col("c") / TILE).alias("subs"))
    # tile pairs of hot values: for each weight the tiles within reach, as a number weight * 2**32 + part
    reach = tiles.select("g", "w", "subs", F.explode(F.sequence(F.greatest(F.col("w") - radius, F.lit(0)), F.col("w") + radius)).alias("w2"))
    other = tiles.select("g", F.col("w").alias("w2"), F.explode(F.sequence(F.lit(0), F.col("subs").cast("int") - 1)).alias("s2"))
    reach = reach.join(other, ["g", "w2"]).select("g", "w", "subs", (F.col("w2") * F.lit(1 << 32) + F.col("s2")).alias("other"))
    hot_rows = rows.join(F.broadcast(hot), "g", "left_semi").join(reach, ["g", "w"]).withColumn("own", F.col("w") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp"), F.col("subs")))
    hot_rows = hot_rows.select(
        "g", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "fp", *more,
    )
    cool = rows.join(F.broadcast(hot), "g", "left_anti").select("g", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(2).alias("side"), "fp", *more)
    units = cool.unionByName(hot_rows).repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")
    return units.mapInArrow(_compare(radius, words), "u bigint, v bigint")


def alike_pairs(sets: list[np.ndarray], label: np.ndarray, alike: float) -> tuple[list[int], list[int]]:
    """Places of pairs with a similarity of at least alike that, with equal labels, span all such pairs."""
    label = label.copy()
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(distinct), bool)
    left, right = [], []
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= alike * np.maximum(sizes[rest], sizes[i]) - 1e-6]
        if not len(rest):
            continue
        mine = number[ends[i] - sizes[i] : ends[i]]
        own[mine] = True
        first, last = ends[rest[0]] - sizes[rest[0]], ends[rest[-1]]
        sums = np.concatenate(([0], np.cumsum(own[number[first:last]])))
        own[mine] = False
        common = sums[ends[rest] - first] - sums[ends[rest] - sizes[rest] - first]
        for j in rest[common / np.maximum(sizes[rest] + sizes[i] - common, 1) >= alike].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                left.append(i)
                right.append(j)
    return left, right


def _exact(units: DataFrame, alike: float) -> DataFrame:
    """units: root, a, b (together a unit), fp, label and set -> links (u, v)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def links() -> pa.RecordBatch:
            fp, label = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            u, v = alike_pairs([np.frombuffer(x[2], np.uint64) for x in held], label, alike)
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], names=["u", "v"])

        for b in batches:
            for *own, fp, label, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != unit:
                    if len(held) > 1:
                        yield links()
                    unit, held = own, []
                held.append((fp, label, shingles))
        if len(held) > 1:
            yield links()

    dealt = units.select("root", "a", "b", "fp", "label", "set").repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _member_sets(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """fp, root and set (packed) of the nodes in components of two and more."""
    groups = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = written(nodes.join(groups, nodes["fp"] == groups["node"]).select(F.col("least").alias("_least"), "fp", "root", "n"), "members")
    same = F.col(key).eqNullSafe(F.col("_least"))
    # texts meet their nodes in one exchange, whatever the size; only texts of members are kept
    texts = written(docs.select(key, text).join(members.hint("merge"), same).select("fp", "root", "n", text), "texts")
    once = texts.filter("n = 1").select("fp", "root", text)
    repeated = texts.filter("n > 1").dropDuplicates(["fp"]).select("fp", "root", text)

    def make():
        return lambda texts, _: {"set": pa.array([shingle_set(x, width).tobytes() for x in texts], pa.binary())}

    return map_text(once.unionByName(repeated), "set binary", make, text)


def verified(docs: DataFrame, nodes: DataFrame, roots: DataFrame, width: int, alike: float, key: str, text: str) -> DataFrame:
    """Links (u, v) that span the pairs of similar shingle sets within the candidate components; a node's least key must belong to one text."""
    sets = written(_member_sets(docs, nodes, roots, width, key, text), "sets")
    sizes = written(sets.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "sizes")
    dealt = F.xxhash64("fp")
    zero = F.lit(0).cast("long")
    rows = sets.join(sizes, "root").withColumn("parts", F.ceil(F.col("m") / UNIT))
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("fp", F.lit(1)), F.col("m")) < PIVOTS)
    part = F.explode(F.when(pivot, F.sequence(zero, F.col("parts") - 1)).otherwise(F.array(F.pmod(dealt, F.col("parts")))))
    found = written(_exact(rows.select("root", part.alias("a"), zero.alias("b"), "fp", F.col("fp").alias("label"), "set"), alike), "found")
    large = sizes.filter(F.col("m") > UNIT)
    if large.isEmpty():
        return found
    joined = components(found).select(F.col("node").alias("fp"), F.col("root").alias("label"))
    marked = sets.select("root", "fp").join(large, "root").join(joined, "fp", "left").select("root", "fp", "m", F.coalesce("label", "fp").alias("label"))
    marked = written(marked, "marked")
    counts = marked.groupBy("root", "m", "label").agg(F.count(F.lit(1)).alias("n"))
    core = counts.groupBy("root", "m").agg(F.max(F.struct("n", "label")).alias("x")).select("root", F.col("x.label").alias("core"), F.col("x.n").alias("n"), "m")
    core = core.filter(F.col("n") < F.col("m")).select("root", "core", F.ceil((F.col("m") - F.col("n")) / UNIT).alias("others"), F.ceil(F.col("n") / UNIT).alias("cores"))
    inside = F.col("label") == F.col("core")
    tiled = marked.join(core, "root").withColumn("t", F.when(inside, F.col("others") + F.pmod(dealt, F.col("cores"))).otherwise(F.pmod(dealt, F.col("others"))))
    reach = F.explode(F.sequence(zero, F.col("others") - 1 + F.when(inside, 0).otherwise(F.col("cores"))))
    tiled = tiled.select("root", "fp", "label", "t", reach.alias("x")).select("root", F.least("t", "x").alias("a"), F.greatest("t", "x").alias("b"), "fp", "label")
    return found.unionByName(_exact(tiled.join(sets.select("fp", "set"), "fp"), alike))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text", words: int = 1, alike: float | None = None) -> DataFrame:
    """Per row: key, fp, component (the smallest key reachable; null only if all keys there are null). With alike (for more words than one) links within the radius are verified on the shingle sets."""
    fps = written(fingerprints(docs, width, (key,), text, words, alike is not None), "fingerprints")
    bits = [F.first("bits").alias("bits"), F.count(F.lit(1)).alias("n")] if words > 1 else []
    nodes = written(fps.groupBy("fp").agg(F.min(key).alias("least"), *bits), "nodes")
    roots = components(links(nodes.drop("least", "n"), radius, words))
    if alike is not None:
        roots = components(verified(docs, nodes, roots, width, alike, key, text))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(named.join(least, "root").select("fp", "component"), "fp").select(key, "fp", "component")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")

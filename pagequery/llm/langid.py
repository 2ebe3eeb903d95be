"""Language identification with hyperdimensional profiles.

A letter is a random +-1 vector, seeded by its code point, so every letter of every script has its own. An n-gram binds (multiplies)
its letters' vectors, each permuted (rotated) by its place. A text bundles (adds) the vectors of all its n-grams, a language those of
all its training texts; a text gets the language whose prototype has the largest cosine. Sums are whole
numbers, so prototypes don't depend on the order or number of tasks.

Letters are lower-cased code points; any run of other characters is one boundary. Vectors are made on demand for the letters and n-grams
of the texts at hand. A text longer than BLOCK characters goes through in pieces that carry its last letters on, which
changes no n-gram. ``und``: the text is null or has no letter, or no
language was learned. Null languages are not learned. Ties go to the first language in order of names. Rows repeated whole give
equal rows, an empty table an empty result; other columns of docs, whatever their names, are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, pick
from .wordhash import mix

DIM = 512
ORDER = 3
SEED = 20240229
#: Characters, and texts, that are handled at once.
BLOCK = 1 << 20
GROUP = 256
#: Cells of a table of counts, and n-grams whose vectors are made at once where such a table would be larger.
CELLS = 1 << 22
PAIRS = 1 << 11
#: Length classes of texts.
CLASSES = 40


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of DIM times +-1 for each code point (0: the boundary)."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        raw = mix(mix(letters.astype(np.uint64) + np.uint64(SEED))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(raw.view(np.uint8), axis=1, bitorder="little").view(np.int8) * np.int8(2) - np.int8(1)


def turned_vectors(letters: np.ndarray) -> list[np.ndarray]:
    """The vectors of letters, permuted for each place of an n-gram."""
    base = letter_vectors(letters)
    return [np.roll(base, ORDER - 1 - k, axis=1) for k in range(ORDER)]


def gram_vectors(places: np.ndarray, turned: list[np.ndarray]) -> np.ndarray:
    """The bound vector of each n-gram; places: a row of ORDER places in letters each."""
    out = turned[0][places[:, 0]]
    for k in range(1, ORDER):
        out *= turned[k][places[:, k]]
    return out


def _bundle(codes: np.ndarray, ends: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of rows, and their numbers of n-grams, of texts as letters with single boundaries; ends and rows: each text's end and row."""
    vectors, grams = np.zeros((n_rows, DIM)), np.zeros(n_rows, np.int64)
    n = len(codes) - ORDER + 1
    if n <= 0:
        return vectors, grams
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    size = len(letters)
    code = (np.cumsum(seen) - 1)[codes]
    turned = turned_vectors(letters)
    gram = np.zeros(n, np.int64)
    for k in range(ORDER):
        gram = gram * size + code[k : n + k]
    own = np.ones(n, bool)
    for k in range(1, ORDER):
        at = ends[:-1] - k
        own[at[(at >= 0) & (at < n)]] = False
    gram, row = gram[own], np.repeat(rows, np.diff(ends, prepend=0))[:n][own]
    if size**ORDER <= CELLS:
        found = np.flatnonzero(np.bincount(gram, minlength=size**ORDER))
        place = np.zeros(size**ORDER, np.int64)
        place[found] = np.arange(len(found))
        place = place[gram]
    else:
        found, place = np.unique(gram, return_inverse=True)
    places = np.column_stack([found // size ** (ORDER - 1 - k) % size for k in range(ORDER)])
    if n_rows * len(found) <= CELLS:
        counts = np.bincount(row * len(found) + place, minlength=n_rows * len(found)).reshape(n_rows, -1)
        for at in range(0, len(found), PAIRS):
            vectors += counts[:, at : at + PAIRS].astype(np.float32) @ gram_vectors(places[at : at + PAIRS], turned).astype(np.float32)
        return vectors, counts.sum(axis=1)
    pairs, times = np.unique(row * len(found) + place, return_counts=True)
    row, place = pairs // len(found), pairs % len(found)
    for at in range(0, len(pairs), PAIRS):
        r, t = row[at : at + PAIRS], times[at : at + PAIRS]
        cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        vectors[r[cuts]] += np.add.reduceat(gram_vectors(places[place[at : at + PAIRS]], turned) * t[:, None].astype(np.float32), cuts, axis=0)
    np.add.at(grams, row, times)
    return vectors, grams


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _single(codes: np.ndarray) -> np.ndarray:
    """Which codes stay if of every run of boundaries one does."""
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return keep


def _short(texts: list[str], rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    codes = _codes("".join(f"\0{x}\0" for x in texts))
    ends = np.cumsum([len(x) + 2 for x in texts])
    keep = _single(codes)
    keep[0] = keep[ends[:-1]] = True
    return _bundle(codes[keep], np.cumsum(keep)[ends - 1], rows, n_rows)


def _long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One text in pieces; each begins with the last ORDER - 1 codes before it."""
    vectors, grams = np.zeros((1, DIM)), np.zeros(1, np.int64)
    carried = np.zeros(1, np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.concatenate((carried, _codes(text[at : at + BLOCK] + ("\0" if at + BLOCK >= len(text) else ""))))
        keep = _single(codes)
        keep[: len(carried)] = True
        codes = codes[keep]
        v, n = _bundle(codes, np.array([len(codes)]), np.zeros(1, np.int64), 1)
        vectors += v
        grams += n
        carried = codes[1 - ORDER :]
    return vectors, grams


def text_vectors(texts: list[str], rows: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, one a text or one for all texts of a row (whole numbers) and numbers of n-grams (0: no letter)."""
    rows = list(range(len(texts))) if rows is None else rows
    n_rows = max(rows, default=-1) + 1
    vectors, grams = np.zeros((n_rows, DIM)), np.zeros(n_rows, np.int64)
    group: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            own, at = np.unique([i for i, _ in group], return_inverse=True)
            v, n = _short([x for _, x in group], at, len(own))
            vectors[own] += v
            grams[own] += n
        group.clear()
        size = 0

    for i, x in zip(rows, texts, strict=True):
        if len(x) > BLOCK:
            v, n = _long(x)
            vectors[i] += v[0]
            grams[i] += n[0]
            continue
        group.append((i, x))
        size += len(x)
        if size >= BLOCK or len(group) >= GROUP:
            flush()
    flush()
    return vectors, grams


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype over every row of docs. What reaches the driver is DIM numbers a language."""
    rows = pick(docs, lang, text).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())

    def bundle(batches):
        sums = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            place = {name: i for i, name in enumerate(dict.fromkeys(langs))}
            v, _ = text_vectors(b.column(1).to_pylist(), [place[x] for x in langs])
            for name, i in place.items():
                sums[name] = sums.get(name, 0) + v[i]
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([np.rint(v).astype(np.int64)], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.mapInArrow(bundle, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        out[r["lang"]] = np.array([p["x"] for p in r["v"]], np.float64)
    return dict(sorted(out.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], key: tuple[str, ...] = ("doc_id",), text: str = "text", keep_text: bool = False, length: bool = False) -> DataFrame:
    """Per row: the key columns (with keep_text the text too), lang_pred and score (the cosine with that language's prototype, cut to 0..1); with length also grams, the number of n-grams."""
    names = list(prototypes)
    unit = np.array([v / max(np.linalg.norm(v), 1e-300) for v in prototypes.values()]).reshape(len(names), DIM)
    shared = docs.sparkSession.sparkContext.broadcast((names, unit))

    def make():
        names, unit = shared.value

        def f(texts, _):
            v, grams = text_vectors([(x or b"").decode("utf-8", "replace") for x in texts])
            more = {"grams": pa.array(grams)} if length else {}
            if not names:
                return {"lang_pred": pa.array(["und"] * len(texts)), "score": pa.array(np.zeros(len(texts)))} | more
            cos = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
            best, known = np.argmax(cos, axis=1), grams > 0
            score = np.where(known, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0)
            return {"lang_pred": pa.array([names[k] if ok else "und" for k, ok in zip(best, known, strict=True)], pa.string()), "score": pa.array(score)} | more

        return f

    return map_text(pick(docs, *key, text), "lang_pred string, score double" + (", grams bigint" if length else ""), make, text, keep_text)


def length_class(grams: Column) -> Column:
    return F.floor(F.log2(F.greatest(grams, F.lit(1)))).cast("int")


def least_scores(marked: DataFrame, lang: str, share: float, part: float) -> dict[str, list[float]]:
    """Language -> the least score of a text of each length class (doublings of n-grams): part of the share quantile of the scores of that language's own texts.

    marked: identify's columns with grams, and the declared language. A length without such texts has the next shorter one's.
    """
    own = marked.filter((F.col("grams") > 0) & (F.col(lang) == F.col("lang_pred")))
    found = own.groupBy("lang_pred", length_class(F.col("grams")).alias("k")).agg(F.percentile_approx("score", share).alias("q")).collect()
    out: dict[str, list[float]] = {}
    for r in sorted(found, key=lambda r: (r["lang_pred"], r["k"])):
        row = out.setdefault(r["lang_pred"], [0.0] * CLASSES)
        row[r["k"] :] = [part * r["q"]] * (CLASSES - r["k"])
    return out

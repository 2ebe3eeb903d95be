"""Words of many texts at once in numpy: byte classes give the boundaries, prefix sums give 64-bit hashes.

A word's hash is a polynomial over its bytes modulo 2**64, shifted to position zero by the
inverse power and mixed; it depends on the word alone. Long texts go through in blocks that end
at blanks, so memory doesn't grow with a text's length (only with its longest word).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
_MASK = (1 << 64) - 1

#: Class 0 separates. WORDS: the six blanks separate. TOKENS: letters (all bytes from 0x80 too), digits, other marks.
#: ALNUM: all but letters and digits separates.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
TOKENS = WORDS * 3
TOKENS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
TOKENS[0x30:0x3A] = 2
ALNUM = ((TOKENS == 1) | (TOKENS == 2)).astype(np.uint8)
ASIS = np.arange(256, dtype=np.uint8)
LOWERED = ASIS.copy()
LOWERED[0x41:0x5B] += 32


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for an odd base."""
    return _powers(max(BLOCK * 2, 1 << (n - 1).bit_length()), base)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15


def _hash_block(a: np.ndarray, classes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = classes[a]
    cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
    at = np.concatenate(([0], cuts, [len(a)]))
    word = k[at[:-1]] != 0
    starts, ends = at[:-1][word], at[1:][word]
    p, inv = powers(len(a), base)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h), starts, ends


def _blocks(raw: bytes) -> list[bytes]:
    """raw in blocks that end before a blank."""
    out, at = [], 0
    while len(raw) - at > BLOCK * 2:
        end = at + BLOCK
        while end < len(raw) and WORDS[raw[end]]:
            end += 1
        out.append(raw[at:end])
        at = end
    out.append(raw[at:])
    return out


def hash_texts(texts: list[bytes | None], classes: np.ndarray = WORDS, letters: np.ndarray = ASIS, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one after the other, and where each text's words start (one more entry than texts)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        raw = b"\n".join(texts[i] or b"" for i in group) + b"\n"
        h, starts, _ = _hash_block(letters[np.frombuffer(raw, np.uint8)], classes, base)
        ends = np.cumsum([len(texts[i] or b"") + 1 for i in group])
        counts[group] = np.diff(np.searchsorted(starts, ends), prepend=0)
        hashes.append(h)
        group.clear()
        size = 0

    for i, x in enumerate(texts):
        n = len(x or b"")
        if n > BLOCK * 2:
            flush()
            for part in _blocks(x):
                h, _, _ = _hash_block(letters[np.frombuffer(part + b"\n", np.uint8)], classes, base)
                hashes.append(h)
                counts[i] += len(h)
            continue
        group.append(i)
        size += n + 1
        if size >= BLOCK:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def hash_word(word: bytes, letters: np.ndarray = ASIS, base: int = BASE) -> int:
    """hash_texts for one word, for indexes made word by word."""
    total, p = 0, 1
    for c in letters[np.frombuffer(word, np.uint8)].tolist():
        total = (total + (c + 1) * p) & _MASK
        p = (p * base) & _MASK
    return int(mix(np.array([total], np.uint64))[0])


WINDOW_BASE = 0xD1342543DE82EF95


def window_hashes(h: np.ndarray, starts: np.ndarray, width: int, base: int = WINDOW_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width words that lie within one text, and the index of each one's first word."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.diff(starts)
    ok = np.ones(n, bool)
    for lag in range(1, width):  # the last width-1 words of a text start no window
        at = starts[1:] - lag
        ok[at[lengths >= lag]] = False
    first = np.flatnonzero(ok)
    p, inv = powers(n, base)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * p[:n], out=sums[1:])
        return mix((sums[first + width] - sums[first]) * inv[first]), first

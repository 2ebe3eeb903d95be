"""Byte-level BPE with tiktoken over a local rank file.

The rank file is read once on the driver and sent to the tasks (about 1 MB, fixed by the file); a worker process builds its
encoding once. Texts over PIECE_CHARS are cut before encoding, only where the split pattern cannot match across: between a
character that is no white space and white space that follows it. Every alternative of the
pattern either holds white space at its start alone or nothing but white space, so a match always
ends there, and the only look-ahead concerns white space before white space. The cut pieces give the
ids of the whole text. A run of RUN and more white space characters, on which tiktoken's matcher would run out of stack, is
split by the same pattern in ``regex`` and its matches are encoded directly; what follows the run cannot change them but for being there.

Null texts encode as the empty text: no ids, empty bytes. Every row gives one row, rows repeated whole too; an empty table gives an empty
result. Other columns of docs, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text, pick

#: Texts beyond this many characters are encoded in pieces of about this size.
PIECE_CHARS = 1 << 16
#: White space from this length on is split apart from the rest of a text.
RUN = 1 << 12
# The characters with the White_Space property.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in pieces of at least size characters, cut at safe boundaries; a text without any stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def spans(text: str, pattern: str, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """text in order: matches of the pattern inside long white space (true), and all between (false)."""
    import regex

    at = 0
    for m in re.finditer(f"[{_SPACE}]{{{run},}}", text):
        if at < m.start():
            yield text[at : m.start()], False
        at = m.start()
        follows = "!" if m.end() < len(text) else ""  # for the pattern one character that is no white space is like another
        for x in regex.finditer(pattern, m[0] + follows):
            if x.end() > len(m[0]):
                break
            yield x[0], True
            at = m.start() + x.end()
    if at < len(text):
        yield text[at:], False


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: The encoding of this process, by rank file and pattern.
_ENCODING: dict[tuple[str, str], object] = {}


def _own_encoding(raw: bytes, pattern: str):
    name = (hashlib.sha256(raw).hexdigest(), pattern)
    if name not in _ENCODING:
        _ENCODING.clear()
        _ENCODING[name] = encoding(parse_ranks(raw), pattern)
    return _ENCODING[name]


def encode_text(enc, text: str) -> np.ndarray:
    def one(x: str) -> np.ndarray:
        return enc.encode_to_numpy(x, allowed_special=set(), disallowed_special=())

    if len(text) <= PIECE_CHARS:
        return one(text)
    out = []
    for part, match in spans(text, enc._pat_str):
        out += [np.array(enc._encode_single_piece(part), np.uint32)] if match else [one(x) for x in pieces(part)]
    return np.concatenate(out)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, key: str | tuple[str, ...] = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the key columns, ``ids`` array<int> and ``decoded`` binary (the bytes that the ids stand for).

    With digests, the same made small where it arises: n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def make():
        enc = _own_encoding(*shared.value)
        decimal = [str(i) for i in range(enc.n_vocab)] if digests else []

        def f(texts, _):
            if digests:
                rows = []
                for x in texts:
                    ids = encode_text(enc, (x or b"").decode("utf-8", "replace")).tolist()
                    rows.append((len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
                return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())))}
            ids = [encode_text(enc, (x or b"").decode("utf-8", "replace")) for x in texts]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            back = [enc.decode_bytes(x.tolist()) for x in ids]
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), "decoded": pa.array(back, pa.binary())}

        return f

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return map_text(pick(docs, *([key] if isinstance(key, str) else key), text), schema, make, text)

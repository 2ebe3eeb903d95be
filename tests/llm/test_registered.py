"""The registered queries, with production parameters on whole tables, against plain Python."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from pagequery.llm import queries
from pagequery.llm.common import table

from .test_exact_ops import groups_by_hand
from .test_models import leaks_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]


@pytest.fixture(scope="module")
def encoding():
    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return tiktoken.Encoding("by hand", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_and_op3(spark, docs):
    quality = {r["doc_id"]: r for r in queries.op1_quality(spark, SF).collect()}
    language = {r["doc_id"]: r for r in queries.op3_language_id(spark, SF).collect()}
    assert quality.keys() == language.keys() == docs.keys()
    for i, t in docs.items():
        q, p = quality[i], language[i]
        assert q["held_out"] == p["held_out"] == (fold(i) == 0) and 0 <= q["score"] <= 1 and 0 <= p["score"] <= 1
        assert q["predicted"] == (q["score"] >= 0.3) and (p["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))


def test_op4(spark, docs, items):
    found = queries.op4_decontaminate(spark, SF).collect()
    by_hand = {(d, i) for d, t in docs.items() for i in leaks_by_hand(items, t)}
    assert by_hand and sorted((r["doc_id"], r["item_id"]) for r in found) == sorted(by_hand)


def test_op7(spark, docs, encoding):
    out = {r["doc_id"]: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    assert out.keys() == docs.keys()
    for i, t in docs.items():
        ids = encoding.encode_ordinary(t or "")
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))


def test_op8(spark, docs):
    ids = sorted(docs)
    fps, label = groups_by_hand([docs[i] for i in ids], 4, 4)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_dedup(spark, SF).collect()}
    assert out == {i: (f"{f:016x}", ids[k]) for i, f, k in zip(ids, fps, label)}


def test_op9(spark, docs):
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    c = Counter(w for i, t in words.items() if fold(i) != 1 for w in t)
    total, distinct = sum(c.values()), len(c)
    out = {r["doc_id"]: r for r in queries.op9_lm_score(spark, SF).collect()}
    assert out.keys() == docs.keys()
    for i, t in words.items():
        r, base = out[i], sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i) == 1, len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def lines_by_hand(docs, least):
    """Each line that at least `least` documents hold stays where it comes first, in the order of the documents' hashes."""
    keyed = {i: [(line, re.sub(r"[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))) for line in (t or "").split("\n")] for i, t in docs.items()}
    often = {k for k, n in Counter(k for lines in keyed.values() for k in {k for _, k in lines}).items() if k and n >= least}
    seen, out = set(), {}
    for i in sorted(keyed, key=lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))):
        kept = []
        for line, k in keyed[i]:
            if k not in often or k not in seen:
                kept.append(line)
                seen.add(k)
        out[i] = "\n".join(kept)
    return out


def alike_by_hand(docs, width, least):
    """The smallest id of each group of texts that share at least `least` of their distinct shingles."""
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if top(i) == i}


def test_pipeline(spark, items, encoding):
    """Languages, tested by hand elsewhere, are the stage's own; all that follows is by hand."""
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.language_id(spark, table(spark, SF, "documents"), SF).collect()}
    kept = lines_by_hand(kept, corpus_pipeline.MIN_LINE_DOCS)
    chosen = alike_by_hand(kept, corpus_pipeline.SHINGLE, corpus_pipeline.ALIKE)
    left = {i: kept[i] for i in chosen if not leaks_by_hand(items, kept[i])}
    assert len(left) < len(chosen) < len(kept)
    out = {r["doc_id"]: (r["text"], r["n_chars"], r["n_tokens"], list(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()}
    assert out.keys() == left.keys()
    for i, t in left.items():
        ids = encoding.encode_ordinary(t)
        assert out[i] == (t, len(t), len(ids), ids)

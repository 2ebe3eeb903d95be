"""Operators with exact results, against plain Python."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequery.llm import ann, bpe, common, linededup, simhash, substring, urlfilter, wordhash

from .conftest import DOCS, docs_of

ODD = [None, "", " \t\n", "a", "A\na\n\n a \r", "é É ü", "x" * 70_000, "word " * 30_000, "\n" * 500, "\x00\x0b\x0c", "‮ 　 space", "a b c", "a b c", "noid"]


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB \t\n\x0b\x0c\réü!9x"), max_size=60)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    raw = [None if t is None else t.encode() for t in texts]
    h, starts = wordhash.hash_texts(raw)
    words = [(t or b"").split() for t in raw]
    assert np.diff(starts).tolist() == [len(w) for w in words]
    assert h.tolist() == [wordhash.hash_word(w) for ws in words for w in ws]
    wins, first = wordhash.window_hashes(h, starts, 3)
    spans = [tuple(ws[i : i + 3]) for ws in words for i in range(len(ws) - 2)]
    assert len(wins) == len(spans) and len(set(wins.tolist())) == len(set(spans))
    assert first.tolist() == [starts[k] + i for k, ws in enumerate(words) for i in range(len(ws) - 2)]


def test_words_of_long_texts(monkeypatch):
    text = b"ab cde  f\n" * 2000 + b"q" * 5000
    whole = wordhash.hash_texts([b"x", text, None])
    monkeypatch.setattr(wordhash, "BLOCK", 512)
    parts = wordhash.hash_texts([b"x", text, None])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def lines_by_hand(rows, min_docs, keep_first=False):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    seen = {}
    for i, t in set(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(i)
    gone = {k for k, d in seen.items() if k and len(d) >= min_docs}
    return {(i, t): [x for x in (t or "").split("\n") if key(x) not in gone] for i, t in rows}


def test_line_dedup(spark):
    texts = ODD + ["Common line\nown %d\n  common LINE\t" % i for i in range(12)] + ["common line"] * 3 + ["É x\nb", "é x\nb"]
    df = docs_of(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = linededup.dedup_lines(df, min_docs=5).collect()
    kept = {(r["doc_id"], r["text"]): r for r in out}
    expected = lines_by_hand(rows, 5)
    from pyspark.sql import functions as F

    got = {(r["doc_id"], r["text"]): r["k"] for r in linededup.dedup_lines(df, min_docs=5).select("doc_id", "text", linededup.kept_text(F.col("text"), F.col("keep")).alias("k")).collect()}
    assert len(out) == len(rows) and got == {k: "\n".join(v) for k, v in expected.items()}
    for (i, t), v in expected.items():
        assert kept[i, t]["n_lines"] == len((t or "").split("\n")) == sum(kept[i, t]["keep"]) and kept[i, t]["n_dropped"] == kept[i, t]["n_lines"] - len(v)
    first = linededup.dedup_lines(df, min_docs=5, keep_first=True).select(linededup.kept_text(F.col("text"), F.col("keep")).alias("k")).collect()
    assert sum(x.strip().lower() == "common line" for r in first for x in r["k"].split("\n")) == 1
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_one_id(spark):
    """Rows that share an id are one document."""
    many = spark.createDataFrame([(1, f"same\nown {i}") for i in range(12)] + [(None, f"void\nown {i}") for i in range(12)] + [(5, "again\nx")] * 12 + [(100 + i, f"ten\n{i}") for i in range(10)], "doc_id long, text string")
    out = linededup.dedup_lines(many, min_docs=10).collect()
    assert len(out) == 46 and {(r["doc_id"] or 0) >= 100: 1 for r in out if r["n_dropped"]} == {True: 1} and sum(r["n_dropped"] for r in out) == 10


def test_line_runs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0, 1, 4], 6), ([5], 6), ([0, 1, 2, 3, 4, 5], 6)], "d array<int>, n int")
    out = [(r[0], r[1]) for r in df.select(linededup._runs(F.col("d"), F.col("n")), linededup.keep_bits(linededup._runs(F.col("d"), F.col("n")))).collect()]
    assert out == [([0, 2, 2, 1, 1], [False, False, True, True, False, True]), ([5, 1, 0], [True] * 5 + [False]), ([0, 6, 0], [False] * 6)]


def repeats_by_hand(rows, width):
    counts = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        counts.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if counts[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 5, 8])
def test_substring(spark, monkeypatch, width):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(substring, "BATCH_BYTES", 3000)
    monkeypatch.setattr(substring, "RANGE_BYTES", 9000)
    phrase = "the quick brown fox jumps over the lazy dog again and again"
    texts = [" ".join(rng.choice(list("abcdefgh"), 40)) + (f" {phrase} " if i % 7 == 0 else " ") + " ".join(rng.choice(list("stuvwxyz"), 30)) for i in range(60)]
    texts += ["word " * 300, None, "", "a", phrase, phrase, texts[0]]
    df = docs_of(spark, texts)
    out = substring.remove_repeats(df, width)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str)
    assert got == repeats_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], width)
    assert all(sum(s["words"] for s in r["repeats"]) == r["n_removed"] for r in out.collect())


def test_substring_of_one_hot_row(spark, monkeypatch):
    """A row repeated many times meets many batches, in few buckets."""
    monkeypatch.setattr(substring, "BATCH_BYTES", 500)
    monkeypatch.setattr(substring, "RANGE_BYTES", 20)
    monkeypatch.setattr(substring, "MAX_BUCKETS", 3)
    hot = " ".join(f"w{i}" for i in range(20))
    df = docs_of(spark, ["x " + hot] * 1).crossJoin(spark.range(200).select()).union(docs_of(spark, ["alone " * 3, None], 50))
    out = [(r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df, 9).collect()]
    assert sorted(out) == sorted([(21, 21)] * 200 + [(3, 0), (0, 0)])


def test_packed_hashes():
    rng = np.random.default_rng(1)
    for n in (1, 7, 5000):
        keys = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
        assert (substring._unpack(*substring._pack(keys)) == keys).all()
    edges = substring._edges(100_000)
    assert len(edges) == 100_001 and edges[0] == 0 and edges[-1] == 1 << 47 and (np.diff(edges.astype(np.int64)) > 0).all()


def test_substring_of_nothing(spark):
    assert substring.remove_repeats(docs_of(spark, ["x"]).limit(0), 5).count() == 0
    assert [r["n_words"] for r in substring.remove_repeats(docs_of(spark, [None]), 5).collect()] == [0]


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture
def ranks(tmp_path):
    table = [bytes([i]) for i in range(256)] + [b"th", b"the", b" the", b"an", b"and", b"  ", b"aa", b"aaaa"]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(table)))
    return str(path)


def test_bpe(spark, ranks):
    enc = bpe.encoding(bpe.load_ranks(ranks), PATTERN)
    df = docs_of(spark, [*ODD, "the and  the\n\n  then aaaaa", "<|endoftext|> it's"])
    out = {(r["doc_id"], r["decoded"].decode()): r["ids"] for r in bpe.encode_decode(df, ranks, PATTERN).collect()}
    assert out == {(r["doc_id"], r["text"] or ""): enc.encode_ordinary(r["text"] or "") for r in df.collect()}
    digests = {r["doc_id"]: r for r in bpe.encode_decode(df, ranks, PATTERN, digests=True).collect()}
    for r in df.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        d = digests[r["doc_id"]]
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), r["text"] or "")))
    assert bpe.encode_decode(df.limit(0), ranks, PATTERN, digests=True).count() == 0
    assert bpe.encode_decode(df.limit(0), ranks, PATTERN).count() == 0


@given(st.text(alphabet=st.sampled_from("the an'\n\t 1é  .s"), max_size=200))
@settings(max_examples=200, deadline=None)
def test_safe_boundaries(text):
    import regex

    parts = list(bpe.pieces(text, 5))
    assert "".join(parts) == text
    assert [m for p in parts for m in regex.findall(PATTERN, p)] == regex.findall(PATTERN, text)


def test_bpe_of_long_white_space(spark, ranks):
    import regex

    enc = bpe.encoding(bpe.load_ranks(ranks), PATTERN)
    for text in (" " * 1_000_000, "a" + " \n" * 500_000 + "the", "\u3000" * 300_000 + "1 ", "a" * 300_000):
        ids = bpe.encode_text(enc, text)
        expected = [i for m in regex.findall(PATTERN, text) for i in enc._encode_single_piece(m)]
        assert ids.tolist() == expected and enc.decode_bytes(ids.tolist()).decode() == text
    out = bpe.encode_decode(docs_of(spark, [" " * 1_000_000] * 2), ranks, PATTERN).collect()
    assert [len(r["decoded"]) for r in out] == [1_000_000] * 2


@given(st.lists(st.sampled_from(["a", "1", "!", "\x1c", "é", "the", " ", "   ", "\n\n\n", "\t \u3000", "\x85\xa0 "]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_white_space_spans(parts):
    import regex

    text = "".join(parts)
    out = []
    for part, match in bpe.spans(text, PATTERN, 3):
        out += [part] if match else [m for x in bpe.pieces(part, 4) for m in regex.findall(PATTERN, x)]
    assert out == regex.findall(PATTERN, text)


def groups_by_hand(texts, width, radius):
    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))] if w else []
        fps.append(sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)))
    label = list(range(len(fps)))
    for _ in fps:
        label = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
    return fps, label


@pytest.mark.parametrize("tile", [4096, 6])
def test_simhash(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("abcde"), 4)) for _ in range(200)]
    texts = [None, "", "a b", "A  b", "a b c d"] + [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 60, 3)] + [" ".join(rng.choice(base, 50)) for _ in range(20)] + ["x y z w"] * 3 + [" ".join(rng.choice(base, 700))] * 2
    fps, label = groups_by_hand(texts, 4, 4)
    out = simhash.near_duplicates(docs_of(spark, texts), 4, 4).collect()
    assert {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in out} == {i: (f, c) for i, (f, c) in enumerate(zip(fps, label))}


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert [r["component"] for r in simhash.near_duplicates(docs_of(spark, ["noid"])).collect()] == [None]


def test_components(spark):
    from pagequery.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100, 201: 200}


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("com/de/", "block")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.ORG/es/1?x#y", "http://example.org/ES/1", "http://example.org", "http://example.org?x=/es/", "ftp://x.com/de/a#b", "http://xcom/de/", "a://b://c/d", "http://É.org/x"]
    out = urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES, urlfilter.fit(urlfilter.LABELLED)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in out] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/ES/1", "org/"), ("example.org", "", None), ("example.org", "", None),
        ("x.com", "/de/a", "com/de/"), ("xcom", "/de/", None), ("b:", "//c/d", None), ("É.org", "/x", "org/"),
    ]
    assert [r["verdict"] for r in out if r["rule"]] == ["block", "allow", "block", "allow"]


def test_long_and_odd_urls(spark):
    import time

    model = urlfilter.fit(urlfilter.LABELLED)
    urls = ["http://h.com/" + "ab" * 100_000, "http://h.com/é😀", "http://h.com/é😀"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    began = time.time()
    out = urlfilter.filter_urls(df, [], model).orderBy("page_id").collect()
    assert [r["logit_micro"] for r in out] == [model[1] + sum(model[0][g] for g in urlfilter.grams("h.com", u[12:])) for u in urls] and time.time() - began < 30
    assert urlfilter.filter_urls(df.limit(0), RULES, model).count() == 0
    same = urlfilter.filter_urls(df, [("h.com/", "allow"), ("h.com/", "block")], model)
    assert {r["verdict"] for r in same.collect()} == {"block"}


def test_url_model_on_other_hosts():
    weights, bias = urlfilter.fit(urlfilter.LABELLED)
    block = "casino-royal.net best-casino-bets.com cheap-viagra-pills.org adult-cams.com free-spam-links.com poker-win-bonus.com hot-dating-singles.net crypto-win-prizes.com".split()
    allow = "science-library.org city-museum.com garden-history.net river-school.info weather-journal.com village-bakery.org mountain-club.net language-museum.com".split()
    right = [(bias + sum(weights[g] for g in urlfilter.grams(h, "/page")) > 0) == want for hosts, want in ((block, True), (allow, False)) for h in hosts]
    assert np.mean(right) >= 0.85


def test_url_model(spark):
    weights, bias = urlfilter.fit(urlfilter.LABELLED)
    right = [(bias + sum(weights[g] for g in urlfilter.grams(h, p)) > 0) == bool(y) for h, p, y in urlfilter.LABELLED]
    assert sum(right) >= 0.98 * len(right)
    rows = [(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(urlfilter.LABELLED)]
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [], (weights, bias)).orderBy("page_id").collect()
    assert [r["logit_micro"] for r in out] == [bias + sum(weights[g] for g in urlfilter.grams(h, p)) for h, p, _ in urlfilter.LABELLED]
    with pytest.raises(ValueError):
        urlfilter.fit(urlfilter.LABELLED, max_labelled=3)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 24)).astype(np.float32))]
    rows += [(1000 + i, rows[0][1]) for i in range(8)] + [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (2005, [1.0, 2.0]), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    ask = (F.col("vec_id") % 50 == 0) | F.col("vec_id").isin(2005, 7)
    out = ann.nearest(df, ask, 5).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q in (0, 50, 1000):
        v = dict(good)[q]
        other = sorted(((-(c @ v) / np.linalg.norm(c) / np.linalg.norm(v), i) for i, c in good if i != q and len(c) == len(v)))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [x[1] for x in got] == [i for _, i in other] and np.allclose([x[2] for x in got], [-s for s, _ in other], atol=1e-12)
    assert not [r for r in out if r["query_id"] in (2000, 2001, 2002, 2003, 2004, 2005)]
    assert ann.nearest(df.limit(0), ask, 5).count() == 0 == ann.nearest(df, F.lit(False), 5).count()


def test_nearest_of_one_id_and_extremes(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [2.0**600] * 2), (2, [2.0**-600] * 2), (3, [-1.0, 0.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).collect()
    half = 0.5**0.5
    expected = [(0, 1, 0, 1.0), (0, 2, 1, half), (0, 3, 2, half)] * 2 + [(0, 1, 1, half), (0, 2, 2, half), (0, 3, 0, 0.0)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in out) == sorted((*e[:3], round(e[3], 12)) for e in expected)


def test_nearest_broadcasts_nothing(spark):
    """Copies of the queries for each part of the index, broadcast, once filled the driver."""
    from pyspark.sql import functions as F

    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).standard_normal((200, 8)))]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert out.count() == 20


def test_nearest_over_many_blocks(spark, monkeypatch):
    """Single and double floats of one length, in blocks of 16 vectors and results returned early, against brute force."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "BLOCK_BYTES", 16 * 8 * 12)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((240, 12))
    v[:120] = v[:120].astype(np.float32)
    v[200:206] = v[0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    expected = []
    for q in range(0, 240, 50):
        scores = [(-round(float(unit[i] @ unit[q]), 12), i) for i in range(240) if i != q]
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5], 1)]
    out = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(x[:3] for x in out) == sorted(x[:3] for x in expected)
    assert np.allclose([x[3] for x in sorted(out)], [x[3] for x in sorted(expected)], atol=1e-11)

    batch = pa.RecordBatch.from_pydict({"id": list(range(240)), "v": v.tolist(), "asked": [i % 50 == 0 for i in range(240)]})
    blocks = list(ann._blocks(16 * 8 * 12)([batch]))
    pairs = [pa.RecordBatch.from_arrays([*b.columns, *q.columns], names=[*b.schema.names, *q.schema.names]) for b in blocks for q in ann._joined(ann._queries(blocks))]
    whole = list(ann._search(5)(pairs))
    assert sum(x.num_rows for x in whole) == 5 * 5
    monkeypatch.setattr(ann, "HELD_ROWS", 0)
    early = list(ann._search(5)(pairs))
    assert len(early) == len(pairs) > len(whole)

    def ranked(found):
        per: dict = {}
        for r in (r for x in found for r in x.to_pylist()):
            per.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
        return {q: sorted(x)[:5] for q, x in per.items()}

    assert ranked(early) == ranked(whole)
    assert {(q, i) for q, found in ranked(whole).items() for _, i in found} == {(e[0], e[2]) for e in expected}


def test_row_groups_of_scratch_tables(spark):
    """Rows of a block's size lie a few to a row group, unpacked, so that readers hold as much as the files say."""
    import pyarrow.parquet as pq

    wide = spark.range(40).selectExpr("id", "cast(repeat('x', 10000) as binary) AS data").coalesce(1)
    found = common.written(wide, "wide", 8)
    files = [f.removeprefix("file://") for f in found.inputFiles()]
    metas = [pq.ParquetFile(f).metadata for f in files]
    assert [m.row_group(g).num_rows for m in metas for g in range(m.num_row_groups)] == [8] * 5
    assert sum(m.row_group(g).column(1).total_compressed_size for m in metas for g in range(m.num_row_groups)) >= 400000
    assert found.count() == 40 and found.filter("length(data) = 10000").count() == 40


def test_recall(spark):
    """Against brute force on a table of many blocks."""
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect() if r["embedding"] is not None and None not in r["embedding"]]
    rows = [(i, v / np.linalg.norm(v)) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, every = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, 5).collect():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.flatnonzero(ids % 50 == 0)
    shares = []
    for q in asked.tolist():
        s = every @ every[q]
        s[q] = -2
        shares.append(len(out[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    assert np.mean(shares) >= 0.98


def test_bounds_of_estimates():
    rng = np.random.default_rng(4)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    codes, corrections = ann.encode(v)
    unit = q / np.linalg.norm(q, axis=1)[:, None]
    guess, error = ann.estimates(codes, corrections, unit @ ann.rotation(64).T)
    true = unit @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    assert (np.abs(guess - true) <= error).mean() > 0.99


@pytest.mark.parametrize("tile", [4096, 8])
def test_wide_simhash(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    base = [list(rng.choice(vocab, 150)) for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.01 else "new" for w in b) for b in base for _ in range(4)] + [None, "", "one two"]
    hashes = [simhash.shingle_hashes(t and t.encode(), 5) for t in texts]
    counts = np.array([len(h) for h in hashes])
    bits = simhash.wide_bits(np.array([x for h in hashes for x in h], np.uint64), counts, 4)
    assert (bits[:, 0] == simhash.fold_bits(np.array([x for h in hashes for x in h], np.uint64), counts)).all()
    near = simhash.distance(bits[:, None], bits[None, :]) <= 46
    label = simhash.forest(len(texts), *np.nonzero(near))
    out = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs_of(spark, texts), 5, 46, words=4).collect()}
    assert out == dict(enumerate(label.tolist()))
    alike = [(i, j) for i in range(48) for j in range(i) if len(set(hashes[i]) & set(hashes[j])) >= 0.85 * len(set(hashes[i]) | set(hashes[j]))]
    assert len(alike) > 20 and np.mean([out[i] == out[j] for i, j in alike]) > 0.95 and all(out[i] // 4 == i // 4 for i in range(48))


@pytest.mark.parametrize("unit", [512, 6])
def test_verified_near_duplicates(spark, monkeypatch, unit):
    monkeypatch.setattr(simhash, "UNIT", unit)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    texts = []
    for share in (0.005, 0.02, 0.03, 0.045, 0.06):  # from close copies to texts that the radius alone takes for copies
        base = list(rng.choice(vocab, 200))
        texts += [" ".join(w if rng.random() > share else str(rng.choice(vocab)) for w in base) for _ in range(12)]
    texts += [None, "", "one two", " ".join(["again and again we say"] * 80), " ".join(["again and again we say"] * 80 + ["but not this"])]
    sets = [set(simhash.shingle_hashes(t and t.encode(), 5)) for t in texts]
    same = np.array([[a == b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = simhash.forest(len(texts), *np.nonzero(same))
    out = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs_of(spark, texts), 5, 60, words=4, alike=0.8).collect()}
    assert out == dict(enumerate(label.tolist()))
    fps = np.array([simhash.wide_bits(np.array(sorted(s), np.uint64), np.array([len(s)]), 4)[0] for s in sets])
    assert (simhash.forest(len(texts), *np.nonzero(simhash.distance(fps[:, None], fps[None, :]) <= 46)) != label).any()

"""Operators that learn, decontamination, the registered queries and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagequery.llm import decontaminate, langid, lmscore, quality, queries
from pagequery.llm.common import numbered, pick

from .conftest import docs_of

SF = "/root/testdata/sf0.001"
ODD = [None, "", "123 !?", "a", "noid", "é" * 5000]


def test_language(spark):
    words = {"aa": "alpha beta gamma delta", "bb": "zwei drei vier fuenf", "cc": "uno dos tres cuatro"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[x].split(), 30)), x, 1.0) for i, x in enumerate(list(words) * 20)] + [(900, None, "aa", 0.0), (901, "text", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = langid.learn(df)
    assert sorted(known) == sorted(words) and all(v.dtype == np.float64 and (v == np.rint(v)).all() for v in known.values())
    out = {r["doc_id"]: r for r in langid.identify(df, known).collect()}
    assert all(out[i]["lang_pred"] == x for i, _, x, _ in rows[:60]) and all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["lang_pred"] == "und"
    odd = [r["lang_pred"] for r in langid.identify(docs_of(spark, ODD), known).collect()]
    assert odd[:3] == ["und"] * 3 and "und" not in odd[3:]
    assert [r["lang_pred"] for r in langid.identify(docs_of(spark, ["abc"]), {}).collect()] == ["und"]
    assert langid.learn(df.limit(0)) == {} and langid.identify(df.limit(0), known).count() == 0


def test_language_vectors_add_up(monkeypatch):
    texts = ["Ab c", "dé f!", "", "x" * 50]
    each, n = langid.text_vectors(texts)
    joined, m = langid.text_vectors(texts, [0, 0, 0, 0])
    assert (each.sum(axis=0) == joined[0]).all() and n.sum() == m[0] and n[2] == 0
    edge, a = (langid.letter_vectors(np.array([c]))[0] for c in (0, ord("a")))
    assert (langid.text_vectors(["A"])[0][0] == np.roll(np.roll(edge, 1) * a, 1) * edge).all()
    monkeypatch.setattr(langid, "BLOCK", 7)
    long, k = langid.text_vectors(texts)
    assert (long == each).all() and (k == n).all()


def bundle_by_hand(text):
    letters = []
    for c in f"\0{text or ''}\0":
        k = ord(c.lower()[0]) if c.isalpha() else 0
        if k or not letters or letters[-1]:
            letters.append(k)
    of = {k: langid.letter_vectors(np.array([k]))[0].astype(int) for k in set(letters)}
    v = [np.roll(of[a], 2) * np.roll(of[b], 1) * of[c] for a, b, c in zip(letters, letters[1:], letters[2:])]
    return np.sum(v, axis=0) if v else np.zeros(langid.DIM, int)


@pytest.mark.parametrize("cells", [1 << 22, 8])
def test_language_against_all_cosines(spark, monkeypatch, cells):
    """The registered query's prototypes and predictions on a table, by hand."""
    monkeypatch.setattr(langid, "CELLS", cells)
    monkeypatch.setattr(langid, "PAIRS", 100)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    texts = [r["text"] for r in rows] + ["Ünïcode žluťoučký 中文字 и кириллица", None, "12"]
    v, grams = langid.text_vectors([t or "" for t in texts])
    by_hand = np.array([bundle_by_hand(t) for t in texts])
    assert (v == by_hand).all() and (grams[-2:] == 0).all()
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    sums: dict = {}
    for r, x in zip(rows, by_hand):
        if r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + x
    names = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    known = langid.learn(df)
    assert list(known) == names and all((known[k] == sums[k]).all() for k in names)
    for r, x in zip(sorted(langid.identify(df, known).collect(), key=lambda r: r["doc_id"]), [x for _, x in sorted(zip([r["doc_id"] for r in rows], by_hand), key=lambda p: p[0])]):
        cos = unit @ x / max(np.linalg.norm(x), 1e-300)
        if r["lang_pred"] != "und":
            assert r["lang_pred"] == names[int(np.argmax(cos))] and abs(r["score"] - max(cos.max(), 0)) < 1e-9
    tie = {"aa": known[names[0]], "ab": known[names[0]]}
    assert {r["lang_pred"] for r in langid.identify(df, tie).collect()} <= {"aa", "und"}


def test_language_held_out(spark):
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97


def test_quality_held_out(spark):
    out = queries.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.9 and out["score"].between(0, 1).all()


def test_quality_odd(spark):
    df = docs_of(spark, [*ODD, "good text here"])
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert quality.classify(df, labels).count() == 7
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0


def test_pool_by_hand(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 7)
    rng = np.random.default_rng(5)
    sizes = [0, 3, 40, 1, 0, 7, 14, 2, 0]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    bucket, vectors = rng.integers(0, quality.BUCKETS, starts[-1]), rng.standard_normal((quality.BUCKETS, quality.DIM)).astype(np.float32)
    for row, a, z in zip(quality.pool(bucket, starts, vectors), starts, starts[1:]):
        v = vectors[bucket[a:z]].astype(float)
        expected = np.concatenate((v.mean(axis=0), v.std(axis=0), (v[:-1] * v[1:]).sum(axis=0) / max(len(v) - 1, 1))) if len(v) else np.zeros(quality.POOLED)
        assert np.allclose(row, expected, atol=1e-3)
    whole, parts = (np.zeros(quality.BUCKETS * quality.DIM, np.int64) for _ in range(2))
    quality.add_contexts(bucket, starts, whole)
    monkeypatch.setattr(quality, "CONTEXTS", 5)
    quality.add_contexts(bucket, starts, parts)
    assert (whole == parts).all()


def test_quality_scores_by_hand(spark):
    """The query's scores on a table, from its own vectors and network, text by text."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, labels, vectors)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, net, ("doc_id",)).collect()}
    for r in docs.collect():
        b, _ = quality.buckets_of([(r["text"] or "").encode()])
        v = vectors[b]
        x = np.concatenate((v.mean(axis=0), v.std(axis=0), (v[:-1] * v[1:]).sum(axis=0) / max(len(v) - 1, 1))) if len(b) else np.zeros(quality.POOLED)
        z = np.tanh((x - net.shift) * net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z / net.temperature))) < 1e-3


def test_quality_of_repeats_and_long_texts(spark):
    df = docs_of(spark, ["good words here"] * 3 + ["w " * 400_000]).selectExpr("*", "0 AS y")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    repeated = df.union(df).union(df)
    out = quality.classify(repeated, labels).collect()
    assert len(out) == 12 and len({r["score"] for r in out if r["doc_id"] < 3}) == 1
    vectors = quality.word_vectors(repeated)
    assert quality.fit(repeated, labels, vectors, max_labelled=2) is not None


def test_word_vectors_by_hand():
    sums = np.zeros(quality.BUCKETS * quality.DIM, np.int64)
    bucket, starts = np.array([1, 2, 3, 1, 5]), np.array([0, 4, 5])
    quality.add_contexts(bucket, starts, sums)
    place, sign = quality._index_vectors()
    expected = np.zeros((quality.BUCKETS, quality.DIM), np.int64)
    for i in range(4):
        for j in range(4):
            if 0 < abs(i - j) <= quality.WINDOW:
                np.add.at(expected[bucket[i]], place[bucket[j]], sign[bucket[j]])
    assert (sums.reshape(expected.shape) == expected).all()
    for x in (np.array([-3, 40000]), np.array([1 << 40]), np.array([0])):
        assert (quality.unpack(quality.pack(x)) == x).all()


def leaks_by_hand(items, text, width=5, overlap=0.8):
    def shingles(t):
        w = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t.lower())
        k = min(width, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set(), k

    found = set()
    for i, t in items:
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())
        parts = [shingles(p) for p in decontaminate.split_item(t or "")]
        if not any(s for s, _ in parts):
            continue
        if all(not s or len(s & {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}) >= overlap * len(s) for s, k in parts):
            found.add(i)
    return found


def test_leaks(spark):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(vocab, n))

    items = [(i, f"{text(rng.integers(8, 40))}. {text(rng.integers(6, 12))}.") for i in range(60)] + [(100, None), (101, ""), (102, "!!"), (103, "one")]
    texts = [None, "", text(500)] + [f"{text(200)} {t.upper()} {text(90)}" for _, t in items[:30]] + [items[5][1] + " " + items[6][1], items[7][1][: len(items[7][1]) // 2]]
    df = docs_of(spark, texts)
    item_df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, item_df).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i in leaks_by_hand(items, t)}
    assert len(got) >= 32
    assert {r["doc_id"]: r["leaks"] for r in decontaminate.count_leaks(df, item_df).collect()} == {d: sum(x == d for x, _ in got) for d in range(len(texts))}
    assert decontaminate.find_leaks(df, item_df.limit(0)).count() == 0 == decontaminate.find_leaks(df.limit(0), item_df).count()


def test_leaks_in_shards_and_long_texts(spark, monkeypatch):
    """Shards and parts of the index change nothing: statistics are those of all items."""
    rng = np.random.default_rng(18)
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(12, 60))) + ". " + " ".join(rng.choice(vocab, 8)) + ".") for i in range(80)]
    items += [items[3], (200, " ".join(rng.choice(vocab, 900)) + ". " + " ".join(rng.choice(vocab, 9)) + ".")]
    texts = [" ".join(rng.choice(vocab, 30_000)) + " " + items[k][1] + " " + " ".join(rng.choice(vocab, 50)) for k in (3, 40, 81)] + ["x " + items[9][1]] * 2
    item_df, df = spark.createDataFrame(items, "item_id long, text string"), docs_of(spark, texts)

    def found():
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.find_leaks(df, item_df).collect())

    whole = found()
    assert {(d, i) for d, i, _ in whole} == {(d, i) for d, t in enumerate(texts) for i in leaks_by_hand(items, t)} and len(whole) >= 6
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 9000)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1500)
    parts = found()
    assert [x[:2] for x in parts] == [x[:2] for x in whole]


def test_wand_finds_all():
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(3, 30)) % 300), None) for i in range(200)]
    index = decontaminate.build_index(rows, 5)
    dense = np.zeros((len(index.terms), len(rows)))
    dense[np.repeat(np.arange(len(index.terms)), np.diff(index.first)), index.items] = index.weights
    for _ in range(60):
        terms = np.unique(rng.integers(0, len(index.terms), 25))
        for threshold in (0.1, 0.3, 0.6):
            scores = dense[terms].sum(axis=0)
            assert sorted(i for i, _ in decontaminate.wand(index, terms, threshold)) == np.flatnonzero(scores >= threshold - 1e-9).tolist()


def test_leaks_answer_column(spark):
    items = spark.createDataFrame([(1, "what is the name of the tall old tree", "sequoia giant")], "item_id long, q string, a string")
    df = docs_of(spark, ["what is the name of the tall old tree", "what is the name of the tall old tree sequoia giant"])
    assert [r["doc_id"] for r in decontaminate.find_leaks(df, items, question="q", answer="a").collect()] == [1]


def counts_by_hand(rows, learn):
    c = Counter()
    for i, t in rows:
        if learn(i):
            c.update([*(t or "").encode().lower().split(), None])
    return c


@pytest.mark.parametrize("near", [4, 1 << 17])
def test_lm(spark, near):
    texts = [None, "", "A b a", "the cat sat on the mat", "The CAT sat", "word " * 3000, "x"] + [f"the dog number {i} sat" for i in range(40)]
    df = pick(docs_of(spark, texts), "doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    c = counts_by_hand(rows, lambda i: i % 5 != 1)
    total, distinct = sum(c.values()), len(c)
    out = lmscore.score_texts(df, df.filter("doc_id % 5 != 1"), near=near, symbols=3, steps=50).collect()
    assert len(out) == len(rows)
    for r in out:
        words = [*(dict(rows)[r["doc_id"]] or "").encode().lower().split(), None]
        base = sum(np.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), total) and abs(r["base_score"] - base) < 1e-9 * max(1, -base)
        assert r["score"] < 0


def test_lm_is_normalised():
    counts = lmscore.Counts(10, 3, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(0, np.int64), np.zeros(8, np.int64), np.zeros(8, np.int64))
    assert counts.look_up(np.array([5], np.uint64))[2].tolist() == [False]
    model = lmscore.train(np.array([1, 18, 35]), np.array([5, 7, 9]), 17, steps=30)
    assert np.allclose((10.0 ** model.log_probabilities()).sum(axis=1), 1, atol=1e-4)


def test_lm_sums_to_one_over_tokens(spark):
    """The score by hand on a tiny vocabulary: over all known tokens and one unseen, probabilities after any token sum to one."""
    rng = np.random.default_rng(6)
    vocab = [f"t{i}" for i in range(12)]
    df = pick(docs_of(spark, [" ".join(rng.choice(vocab, 30, p=np.arange(1, 13) / 78)) for _ in range(40)]), "doc_id", "text")
    pairs = spark.createDataFrame([(100 * i + j, f"{a} {b}".strip()) for i, a in enumerate([*vocab, "unseen"]) for j, b in enumerate([*vocab, "unseen"])], "doc_id long, text string")
    for symbols, near in ((3, 6), (20, 100)):
        table = lmscore.count_tokens(df)
        counts = lmscore.bounded_counts(table, symbols, near)
        found = lmscore.count_pairs(df, counts).toArrow()
        model = lmscore.train(found["pair"].to_numpy(), found["n"].to_numpy(), counts.symbols + lmscore.CLASSES, 60)
        p = model.log_probabilities()
        true = {r["h"]: r["c"] for r in table.collect()}

        def parts(text):
            h = lmscore.tokens([text.encode()])[0]
            symbol, c, known = counts.look_up(h)
            c = np.array([true.get(int(x), 0) for x in h.view(np.int64)])
            k = np.maximum(symbol - counts.symbols, 0)
            own = np.where(symbol >= counts.symbols, np.log10((c + 0.5) / (counts.class_total[k] + 0.5 * (counts.class_distinct[k] + 1))), 0.0)
            return symbol, own

        end = parts("")[0][0]
        for r in lmscore.score_texts(pairs, df, symbols=symbols, near=near, steps=60).join(pairs, "doc_id").collect():
            symbol, own = parts(r["text"])
            by_hand = sum(p[a, b] + o for a, b, o in zip([end, *symbol], symbol, own))
            assert abs(by_hand - r["score"]) < 1e-4, (r, by_hand)
        after = p[parts("t5")[0][0]]
        seen = sum(10.0 ** (after[s] + o) for w in vocab for s, o in [tuple(x[0] for x in parts(w))])
        seen += 10.0 ** (after[end] + parts("")[1][0])
        assert seen <= 1 + 1e-4


def test_lm_held_out(spark):
    """Texts not learned from are likelier to the model than to single tokens' frequencies."""
    out = queries.op9_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out["s"] > out["b"]


def test_lm_learns():
    size = 40
    pair = np.array([u * size + (u + 1) % size for u in range(size)] + [u * size + 3 for u in range(size)])
    n = np.array([90] * size + [10] * size)
    p = lmscore.train(pair, n, size, steps=800).log_probabilities()
    assert np.mean([p[u, (u + 1) % size] for u in range(size)]) > np.log10(1 / size) + 0.5


def test_lm_of_nothing(spark):
    df = pick(docs_of(spark, ["a b"]), "doc_id", "text")
    r = lmscore.score_texts(df, df.limit(0), steps=5).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_pick_and_numbered(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A int, b int")
    assert pick(df, "A", "b").collect()[0].asDict() == {"A": 2, "b": 3}
    assert numbered(df)[1] == ["a", "A", "b"]


def test_pipeline_stages(spark):
    copies = "this very same text stands in many documents of the corpus here"
    texts = [None, "", "...", copies, copies, "unlike all of the others in this small corpus of texts", "noid"] + [f"License line\nown words number {i} alone" for i in range(12)]
    df = docs_of(spark, texts).withColumnRenamed("TEXT2", "Text")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, df, SF)
    assert kept.columns == df.columns and kept.count() == len(texts) - 3
    lines = stages["line_dedup"](spark, df, SF)
    assert lines.columns == df.columns and lines.count() == len(texts)
    assert sum("License" in (r["text"] or "") for r in lines.collect()) == 1
    groups = stages["simhash_dedup"](spark, df, SF)
    found = pick(groups, "doc_id", "text").collect()
    assert groups.columns == df.columns and [r["doc_id"] for r in found if r["text"] == copies] == [3]
    assert sum(not (r["text"] or "").strip() for r in found) == 1
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = stages["decontamination"](spark, df.union(docs_of(spark, [f"x {leak} y"], 500).withColumnRenamed("TEXT2", "Text")), SF)
    assert clean.columns == df.columns and clean.count() == len(texts)
    last = stages["byte_bpe"](spark, df, SF)
    assert last.columns == [*df.columns, "n_tokens", "ids"]
    assert sorted(r["text"] for r in last.collect()) == sorted(t or "" for t in texts)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    whole = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() <= whole and {"doc_id", "text", "ids", "n_tokens"} <= set(out.columns)


def test_folds(spark):
    out = queries.op3_language_id(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_lm_symbols(spark):
    words = [f"w{i}" for i in range(3000)]
    df = docs_of(spark, [" ".join(words[:2031])] * 2 + [" ".join(words)])
    counts = lmscore.bounded_counts(lmscore.count_tokens(df))
    assert counts.symbols == 2032 and (counts.look_up(lmscore.tokens([" ".join(words[:2031]).encode()])[0])[0] < 2032).all()


def test_pipeline_rejects_no_language(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")

    def junk(first, n):
        return " ".join("".join(chr(first + x) for x in rng.integers(0, n, rng.integers(3, 9))) for _ in range(200))

    planted = [(-1 - 4 * i - k, junk(*alphabet), "en") for i in range(5) for k, alphabet in enumerate([(97, 26), (0x430, 32), (0x3B1, 25), (0xAC00, 11172)])]
    both = docs.union(spark.createDataFrame(planted, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, both, SF).select("doc_id").collect()}
    clean = [(r["doc_id"], len(r["text"] or "")) for r in docs.collect()]
    assert not any(p[0] in kept for p in planted)
    assert np.mean([i in kept for i, _ in clean]) > 0.99 and all(i in kept for i, n in clean if 0 < n < 200)


def test_language_floor_with_many_rejects(spark):
    rng = np.random.default_rng(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = rng.integers(97, 123, (300, 200, 6))
    planted = [(-1 - i, " ".join("".join(map(chr, word)) for word in text), "en") for i, text in enumerate(letters.tolist())]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(planted, docs.schema)), SF).select("doc_id").collect()}
    clean = [(r["doc_id"], len(r["text"] or "")) for r in docs.collect()]
    assert sum(p[0] in kept for p in planted) <= 3
    assert np.mean([i in kept for i, _ in clean]) > 0.99 and all(i in kept for i, n in clean if 0 < n < 200)

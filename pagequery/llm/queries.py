"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, langid, linededup, lmscore, quality, simhash, substring, urlfilter
from .common import LOWER, UPPER, fold, pick, table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = pick(table(spark, sf_dir, "labels"), "doc_id", "quality").filter(fold() != 0)
    out = quality.classify(docs, labels)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, urlfilter.fit(urlfilter.LABELLED))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = pick(docs, "doc_id", "text", "lang")
    prototypes = langid.learn(rows.filter(fold() != 0))
    out = langid.identify(rows, prototypes)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = linededup.kept_text(F.col("text"), F.col("keep"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("held_out", fold() == 1)
    return lmscore.score_texts(docs, docs.filter(~F.col("held_out")), ("doc_id", "held_out"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def _url_sql() -> str:
    weights, bias = urlfilter.fit(urlfilter.LABELLED)
    rules = sorted(URL_RULES, key=lambda r: -len(r[0]))

    def case(pick) -> str:
        whens = []
        for text, verdict in rules:
            h, slash, p = text.partition("/")
            whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}') THEN '{pick(text, verdict)}'")
        return "CASE " + " ".join(whens)

    return f"""
    WITH cut AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    strs AS (SELECT *, '^' || host || '|' || path || '$' AS s FROM parts),
    scored AS (SELECT page_id, host, path, CAST({bias} + list_sum(list_transform(range(1, length(s) - 1), lambda i: w[(unicode(substr(s, i, 1)) * 17161 + unicode(substr(s, i + 1, 1)) * 131 + unicode(substr(s, i + 2, 1))) % {urlfilter.BUCKETS} + 1])) AS BIGINT) AS logit_micro
      FROM strs, (SELECT {weights} AS w))
    SELECT page_id, host, path, {case(lambda t, v: t)} END AS rule, {case(lambda t, v: v)} ELSE CASE WHEN logit_micro > 0 THEN 'block' ELSE 'allow' END END AS verdict, logit_micro FROM scored
    """


LINES_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= 10),
marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

REPEATS_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
starts AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS pos FROM docs),
windows AS (SELECT rid, pos, sha256(array_to_string(w[pos:pos + 34], ' ')) AS h FROM starts),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, pos + j AS pos FROM windows SEMI JOIN often USING (h), range(0, 35) t(j)),
marked AS (SELECT words.*, gone.pos IS NOT NULL AS gone FROM words LEFT JOIN gone USING (rid, pos)),
summed AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN summed USING (rid)
"""

NEAREST_SQL = """
WITH rows AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM rows q JOIN rows c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {f.__name__: f for f in (op1_quality, op2_url_filter, op3_language_id, op4_decontaminate, op5_line_dedup, op6_substring_dedup, op7_byte_bpe, op8_simhash_dedup, op9_lm_score, op10_nearest)}


def sql() -> dict[str, str]:
    return {"op2_url_filter": _url_sql(), "op5_line_dedup": LINES_SQL, "op6_substring_dedup": REPEATS_SQL, "op10_nearest": NEAREST_SQL}

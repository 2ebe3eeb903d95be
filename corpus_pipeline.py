"""From documents to token ids: language ID, line dedup, SimHash near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, whatever they are; the last adds n_tokens and ids and has
the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm import bpe, decontaminate, langid, linededup, simhash
from pagequery.llm.common import numbered, table, written

#: Documents are rejected whose best cosine with a language, raised by its sampling error 1 / sqrt(n-grams), is not above LANGUAGE_PART of the LANGUAGE_SHARE quantile of that
#: language's own texts of like length, as are those without a letter. The median holds however many such documents there are below a half; the error keeps short texts.
LANGUAGE_SHARE, LANGUAGE_PART = 0.5, 1 / 4
MIN_LINE_DOCS = 10
#: Near-duplicates share at least 0.8 of their five-word shingles. Candidates are those whose fingerprints differ in at most 60 of 256 bits (39 on average at 0.8).
SHINGLE, WORDS, RADIUS, ALIKE = 5, 4, 60, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names; the others go."""
    rows, names = numbered(docs)
    text, lang = (rows.columns[names.index(c)] for c in ("text", "lang"))
    prototypes = langid.learn(docs)
    marked = written(langid.identify(rows, prototypes, tuple(c for c in rows.columns if c != text), text, keep_text=True, length=True), "marked")
    least = langid.least_scores(marked, lang, LANGUAGE_SHARE, LANGUAGE_PART)
    floor = F.lit(0.0)
    for name, row in least.items():
        floor = F.when(F.col("lang_pred") == name, F.get(F.array(*map(F.lit, row)), langid.length_class(F.col("grams")))).otherwise(floor)
    likely = F.col("score") + 1 / F.sqrt(F.greatest(F.col("grams"), F.lit(1)))
    return marked.filter((F.col("lang_pred") != "und") & (likely > floor)).select(*rows.columns).toDF(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; every document stays, n_chars follows its text."""
    rows, names = numbered(docs)
    key, text = (rows.columns[names.index(c)] for c in ("doc_id", "text"))
    out = linededup.dedup_lines(rows, MIN_LINE_DOCS, keep_first=True, key=key, text=text, also=tuple(c for c in rows.columns if c not in (key, text)))
    out = out.withColumn("_kept", linededup.kept_text(F.col(text), F.col("keep")))
    new = {text: F.col("_kept")}
    if "n_chars" in names:
        new[rows.columns[names.index("n_chars")]] = F.char_length("_kept").cast("long")
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns]).toDF(*names)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; ids may repeat or be null, rows of one id and text count once."""
    rows, names = numbered(docs)
    key, text = (rows.columns[names.index(c)] for c in ("doc_id", "text"))
    own = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key), F.lit(0)).alias("id"), F.xxhash64(key, text).alias("hash"))
    rows = rows.withColumn("_row", own)
    groups = simhash.near_duplicates(rows, SHINGLE, RADIUS, "_row", text, WORDS, ALIKE)
    chosen = written(groups.filter(F.col("_row") == F.col("component")).groupBy("_row").agg(F.count(F.lit(1)).alias("n")), "chosen")
    once = rows.join(chosen.filter("n = 1"), "_row", "left_semi")
    repeated = rows.join(chosen.filter("n > 1"), "_row", "left_semi").dropDuplicates(["_row"])
    return once.unionByName(repeated).drop("_row").toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    rows, names = numbered(docs)
    counted = decontaminate.count_leaks(rows, table(spark, sf_dir, "benchmark"), text=rows.columns[names.index("text")], out="_leaks")
    return counted.filter(F.col("_leaks") == 0).drop("_leaks").toDF(*names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and ids; text is what the ids decode to."""
    import public_tokenizers

    rows, names = numbered(docs)
    text = rows.columns[names.index("text")]
    out = bpe.encode_decode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple(c for c in rows.columns if c != text), text)
    cols = [F.col("decoded").cast("string").alias(c) if c == text else F.col(c) for c in rows.columns]
    return out.select(*cols, F.size("ids").cast("long").alias("_n"), "ids").toDF(*names, "n_tokens", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Language prototypes and fingerprints have no SQL form; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

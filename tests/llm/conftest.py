DOCS = "doc_id long, text string, lang string, TEXT2 string, score double"


def docs_of(spark, texts, start=0):
    """Rows with columns that clash with the operators' own names."""
    return spark.createDataFrame([(None if t == "noid" else start + i, t, "en", "x", 1.0) for i, t in enumerate(texts)], DOCS)

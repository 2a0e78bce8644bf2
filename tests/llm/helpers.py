"""Rows that every operator on documents must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, key string, pos string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in rows], DOCS)

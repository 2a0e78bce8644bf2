"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and gets all rows that the one before it
kept; run() writes each stage's rows as Parquet in the shared folder and reads
them back. All stages but the last return the columns of documents; the last
returns doc_id, the ids of the text that is left and the digests of the ids and of
the decoded bytes.

Edge cases: null texts stay null through the filters and count as empty in the
last stage; documents whose lines are all dropped stay with an empty text, since
only the filtering stages remove documents; extra columns pass through, whatever
their names; a filter removes a row by its doc_id and text together, so that rows of
one doc_id with other texts stay; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, decontam, linededup, nearjoin, toxicity
from cuelake.llm.common import drop_stored, stored
from cuelake.llm.queries import split_pattern, table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not reject."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that a later document holds too; n_chars follows."""
    kept = linededup.dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    text = F.when(F.col("was_null"), F.lit(None).cast("string")).otherwise(F.col("kept"))
    columns = {"doc_id": F.col("doc_id"), "text": text}
    for c in docs.columns:
        if c == "n_chars":
            columns[c] = F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col("carried").getField(c))
        elif c not in columns:
            columns[c] = F.col("carried").getField(c)
    return kept.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in docs.schema))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return nearjoin.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed), ids_sha256, decoded_sha256 of each whole text."""
    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern()
    coded = bpe.round_trip(docs, path, pattern)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The first stage's model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_stored(before)
        before = docs
    return docs

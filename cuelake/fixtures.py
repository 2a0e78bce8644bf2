"""Words and cues made from the driver's tables for its queries, in Spark and in SQL.

The clock is artificial and lives here only; the library itself never makes up times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.timecode import make_cue_id, make_id
from .operators.segmentation import by_document


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_words(texts: DataFrame) -> DataFrame:
    """doc_id, seq, word_id, text, start_ms, end_ms, confidence of texts (doc_id, text)."""
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n\t\r]+"), lambda x: x != "")
    # Texts are dealt, not their words.
    rows = by_document(texts.select("doc_id", "text"), "text").select("doc_id", F.posexplode(tokens).alias("_i", "text")).withColumn("seq", F.col("_i") + 1)
    gap = F.when(T.ends_sentence(F.col("text")), 900).when(F.col("seq") % 13 == 0, 700).otherwise(40 * (F.col("seq") % 3))
    rows = rows.withColumns({"_dur": 60 * F.length("text") + 40, "_gap": gap})
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_dur") + F.col("_gap")).over(before), F.lit(0)).cast("bigint")
    return rows.withColumn("start_ms", start).select("doc_id", "seq", make_id("w", F.col("seq")).alias("word_id"), "text", "start_ms", (F.col("start_ms") + F.col("_dur")).cast("bigint").alias("end_ms"), F.lit(None).cast("double").alias("confidence"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_words(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


def no_segments(words: DataFrame) -> DataFrame:
    """A segments table without rows."""
    kinds = {x.name: x.dataType for x in words.schema}
    none = lambda name, of: F.lit(None).cast(kinds[of]).alias(name)
    columns = [none(n, of) for n, of in (("doc_id", "doc_id"), ("seq", "seq"), ("segment_id", "word_id"), ("text", "text"), ("start_ms", "start_ms"), ("end_ms", "end_ms"))]
    # Made of nothing, so that no step reads the words for it.
    return words.sparkSession.range(1).where("false").select(*columns, F.array().cast("array<string>").alias("word_ids"))


def word_segments(words: DataFrame) -> DataFrame:
    """One segment for each ten words."""
    n = F.floor((F.col("seq") - 1) / 10) + 1
    grouped = words.groupBy("doc_id", n.cast("int").alias("seq")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sort_array(F.collect_list(F.struct(F.col("seq").alias("n"), "word_id", "text"))).alias("_w")
    )
    return grouped.select("doc_id", "seq", make_id("seg", F.col("seq")).alias("segment_id"), F.array_join(F.col("_w.text"), " ").alias("text"), "start_ms", "end_ms", F.col("_w.word_id").alias("word_ids"))


def conversation_cues(spark: SparkSession, sf_dir: str, translated: bool = True) -> DataFrame:
    """Cues of the turns, some short, some overlapping, some without or with unchanged translation."""
    c, n = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    dur = F.when((c + n) % 9 == 0, F.lit(500)).otherwise(300 + (40 + 8 * ((3 * c + n) % 6)) * F.length("text"))
    rows = rows.withColumns({"_dur": dur, "_gap": 100 * (n % 3)})
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.when(((c + n) % 7 == 6) & (n > 0), 500).otherwise(0)
    start = (F.coalesce(F.sum(F.col("_dur") + F.col("_gap")).over(before), F.lit(0)) - shift).cast("bigint")
    other = F.when((c + n) % 5 == 4, F.lit(None).cast("string")).when((c + n) % 5 == 3, F.col("text")).otherwise(F.concat(F.lit("[en] "), "text"))
    none = F.lit(None).cast("string")
    return rows.withColumn("start_ms", start).select(
        c.alias("doc_id"), (n + 1).cast("int").alias("seq"), make_cue_id(n + 1).alias("cue_id"), "start_ms", (F.col("start_ms") + F.col("_dur")).cast("bigint").alias("end_ms"),
        F.col("text").alias("source_text"), none.alias("corrected_text"), (other if translated else none).alias("translated_text"),
        F.array().cast("array<string>").alias("source_word_ids"), F.array().cast("array<string>").alias("warnings"),
    )


def cue_documents(cues: DataFrame, target: str | None = "en") -> DataFrame:
    return cues.select("doc_id").distinct().select("doc_id", F.lit("und").alias("source_language"), F.lit(target).cast("string").alias("target_language"))


def glossary(spark: SparkSession) -> DataFrame:
    from .sources.transcripts import glossary_table

    return glossary_table(spark, [("the", "THE", None), ("and", "und", None), ("THE", None, "kept"), ("of", "o'", None)])


def joined(column: Column, mark: str = "|") -> Column:
    return F.array_join(column, mark)


WORDS_SQL = r"""
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\t\r]+'), lambda x: x <> '') AS l FROM ({texts})),
w0 AS (SELECT doc_id, unnest(l) AS text, unnest(range(1, len(l) + 1))::INT AS seq FROM toks),
w1 AS (SELECT *, 60 * length(text) + 40 AS dur,
         CASE WHEN regexp_matches(text, '[。！？.!?;；]$') THEN 900 WHEN seq % 13 = 0 THEN 700 ELSE 40 * (seq % 3) END AS gap FROM w0),
w2 AS (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM w1),
words AS (SELECT doc_id, seq, printf('w%06d', seq) AS word_id, text, start_ms, (start_ms + dur)::BIGINT AS end_ms FROM w2),
pieces AS (SELECT *, coalesce(greatest(lead(start_ms) OVER (PARTITION BY doc_id ORDER BY seq) - end_ms, 0), 0) AS gap_after_ms,
         lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) IS NULL AS is_last, regexp_matches(text, '[。！？.!?;；]\s*$') AS ends FROM words)"""
DOCUMENT_WORDS = WORDS_SQL.replace("{texts}", "SELECT doc_id, text FROM documents")
TURN_WORDS = WORDS_SQL.replace("{texts}", "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations")
#: Needs boundaries(doc_id, seq) and pieces.
CUES_OF = r"""
marked AS (SELECT p.*, CASE WHEN b.seq IS NULL THEN 0 ELSE 1 END AS cut, lag(p.text) OVER (PARTITION BY p.doc_id ORDER BY p.seq) AS before
           FROM pieces p LEFT JOIN (SELECT DISTINCT doc_id, seq FROM boundaries) b ON p.doc_id = b.doc_id AND p.seq = b.seq),
numbered AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT + 1 AS cue FROM marked),
glued AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, cue ORDER BY seq) = 1
             OR regexp_matches(text, '^[，。！？；：、,.!?;:)\]}」』\s\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]')
             OR regexp_matches(before, '[(\[{「『\s\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]$') THEN text ELSE ' ' || text END AS part FROM numbered),
cues AS (SELECT doc_id, cue AS seq, printf('cue%06d', cue) AS cue_id, min_by(start_ms, seq) AS start_ms, max_by(end_ms, seq) AS end_ms,
           string_agg(part, '' ORDER BY seq) AS source_text, string_agg(word_id, ',' ORDER BY seq) AS word_ids FROM glued GROUP BY doc_id, cue)"""
TURN_CUES = r"""
t0 AS (SELECT conv_id, turn, coalesce(text, '') AS text,
         CASE WHEN (conv_id + turn) % 9 = 0 THEN 500 ELSE 300 + (40 + 8 * ((3 * conv_id + turn) % 6)) * length(coalesce(text, '')) END AS dur, 100 * (turn % 3) AS gap FROM conversations),
t1 AS (SELECT *, (coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         - CASE WHEN (conv_id + turn) % 7 = 6 AND turn > 0 THEN 500 ELSE 0 END)::BIGINT AS start_ms FROM t0),
cues AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS seq, printf('cue%06d', turn + 1) AS cue_id, start_ms, (start_ms + dur)::BIGINT AS end_ms, text AS source_text,
           CAST(NULL AS VARCHAR) AS corrected_text,
           CASE WHEN (conv_id + turn) % 5 = 4 THEN NULL WHEN (conv_id + turn) % 5 = 3 THEN text ELSE '[en] ' || text END AS translated_text FROM t1)"""
#: Needs pieces and proposed(doc_id, seq); the greedy cutter as a fold over the pieces of each span between proposed cuts.
CONSTRAIN = r"""
c0 AS (SELECT p.doc_id, p.seq, p.start_ms AS s, p.end_ms AS e, q.seq IS NOT NULL AS proposed, ends OR gap_after_ms >= 700 AS pause,
         length(regexp_replace(text, '[^\x{{3000}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]', '', 'g')) AS cjk,
         len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS lat, length(replace(text, ' ', '')) AS chars
       FROM pieces p LEFT JOIN (SELECT DISTINCT doc_id, seq FROM proposed) q ON p.doc_id = q.doc_id AND p.seq = q.seq),
c1 AS (SELECT *, coalesce(sum(proposed::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM c0),
c2 AS (SELECT doc_id, list({{'seq': seq, 's': s, 'e': e, 'cjk': cjk, 'lat': lat, 'chars': chars, 'pause': pause, 'proposed': proposed}} ORDER BY seq) AS l FROM c1 GROUP BY doc_id, span),
c3 AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE
    CASE WHEN x.proposed THEN 1 WHEN NOT ({over}) THEN 0 WHEN x.pause OR (a.cand IS NULL AND NOT a.some) THEN 1 WHEN a.cand IS NOT NULL THEN 2 ELSE 3 END
    WHEN 0 THEN {{'some': true, 's': {s}, 'cjk': a.cjk + x.cjk, 'lat': a.lat + x.lat, 'chars': a.chars + x.chars,
      'cand': CASE WHEN x.pause THEN x.seq ELSE a.cand END, 'c_cjk': CASE WHEN x.pause THEN a.cjk + x.cjk ELSE a.c_cjk END, 'c_lat': CASE WHEN x.pause THEN a.lat + x.lat ELSE a.c_lat END,
      'c_chars': CASE WHEN x.pause THEN a.chars + x.chars ELSE a.c_chars END, 'next_s': CASE WHEN NOT x.pause AND a.cand IS NOT NULL THEN coalesce(a.next_s, x.s) END, 'seq': x.seq, 'cuts': a.cuts}}
    WHEN 1 THEN {{'some': false, 's': 0::BIGINT, 'cjk': 0::BIGINT, 'lat': 0::BIGINT, 'chars': 0::BIGINT, 'cand': NULL::INT, 'c_cjk': 0::BIGINT, 'c_lat': 0::BIGINT, 'c_chars': 0::BIGINT, 'next_s': NULL::BIGINT, 'seq': x.seq, 'cuts': list_append(a.cuts, x.seq)}}
    WHEN 2 THEN {{'some': true, 's': coalesce(a.next_s, x.s), 'cjk': a.cjk + x.cjk - a.c_cjk, 'lat': a.lat + x.lat - a.c_lat, 'chars': a.chars + x.chars - a.c_chars, 'cand': NULL::INT,
      'c_cjk': 0::BIGINT, 'c_lat': 0::BIGINT, 'c_chars': 0::BIGINT, 'next_s': NULL::BIGINT, 'seq': x.seq, 'cuts': list_append(a.cuts, a.cand)}}
    ELSE {{'some': true, 's': x.s, 'cjk': x.cjk::BIGINT, 'lat': x.lat::BIGINT, 'chars': x.chars::BIGINT, 'cand': NULL::INT, 'c_cjk': 0::BIGINT, 'c_lat': 0::BIGINT, 'c_chars': 0::BIGINT, 'next_s': NULL::BIGINT, 'seq': x.seq, 'cuts': list_append(a.cuts, a.seq)}} END,
    {{'some': false, 's': 0::BIGINT, 'cjk': 0::BIGINT, 'lat': 0::BIGINT, 'chars': 0::BIGINT, 'cand': NULL::INT, 'c_cjk': 0::BIGINT, 'c_lat': 0::BIGINT, 'c_chars': 0::BIGINT, 'next_s': NULL::BIGINT, 'seq': NULL::INT, 'cuts': []::INT[]}}) AS a FROM c2),
boundaries AS (SELECT doc_id, unnest(a.cuts) AS seq FROM c3 UNION SELECT doc_id, seq FROM pieces WHERE is_last)""".format(
    s="CASE WHEN a.some THEN a.s ELSE x.s END",
    over="""x.e - CASE WHEN a.some THEN a.s ELSE x.s END > 7000 OR a.cjk + x.cjk > 24 OR a.lat + x.lat > 14
      OR (x.e - CASE WHEN a.some THEN a.s ELSE x.s END >= 3500 AND (a.chars + x.chars) / greatest((x.e - CASE WHEN a.some THEN a.s ELSE x.s END) / 1000.0, 0.001) > 17)""",
)

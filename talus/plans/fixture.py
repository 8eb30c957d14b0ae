"""Utterances made of the driver's documents, for Spark and for DuckDB.

Every document is cut into pieces of twelve words, all of them, so texts are used whole. DuckDB's edit distance counts
bytes; its SQL therefore gives each of the letters in ``ACCENTED`` one byte of its own before it measures, which changes no
distance. Three methods' predictions are edits of the piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions.metrics import cer, critical, duration_bucket, rounded, zero_shot_bucket
from talus.operators.shared import dealt

WORDS = 12
# The letters outside ASCII that the driver's documents have; in SQL, each is a control character from 1 on.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
METHODS = {"zero_shot": "zero_pred", "baseline": "base_pred", "new_method": "new_pred"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n (place in the document), gt, source, lang."""
    words = F.filter(F.split("text", "[ \\t\\n\\r\\f\\x0b]+"), lambda w: w != "")
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id").select("doc_id", "source", "lang", words.alias("words"))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / WORDS).cast("int"))
    parts = F.filter(F.transform(starts, lambda i: F.array_join(F.slice("words", F.greatest(i, F.lit(0)) * WORDS + 1, WORDS), " ")), lambda part: part != "")
    return docs.select("doc_id", "source", "lang", F.posexplode(parts).alias("n", "gt"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, gt = F.col("doc_id") + F.col("n"), F.col("gt")
    rows = pieces(spark, sf_dir).select(
        (F.col("doc_id") * 100000 + F.col("n")).alias("utt_id"), F.col("source").alias("speaker_id"), F.col("lang").alias("disease_tag"),
        ((F.col("doc_id") % 7 + 1) * F.length("gt") / F.lit(30.0)).alias("duration"),
        F.when(F.col("doc_id") % 10 == 9, "test").when(F.col("doc_id") % 10 == 8, "dev").otherwise("train").alias("split"), "gt",
        F.when(k % 5 == 0, gt).when(k % 5 == 1, F.replace(gt, F.lit("e"), F.lit("a"))).when(k % 5 == 2, F.substring(gt, 1, 40)).when(k % 5 == 3, "").otherwise(F.reverse(gt)).alias("zero_pred"),
        F.when(k % 4 == 0, gt).when(k % 4 == 1, F.replace(gt, F.lit("t"), F.lit("d"))).when(k % 4 == 2, F.substring(gt, 1, 60)).otherwise(F.replace(gt, F.lit(" "), F.lit(""))).alias("base_pred"),
        F.when(k % 6 == 1, F.substring(gt, 1, 50)).when(k % 6 == 2, "").when(k % 6 == 3, F.replace(gt, F.lit("n"), F.lit("m"))).when(k % 6 == 5, F.reverse(gt)).otherwise(gt).alias("new_pred"),
    )
    rows = rows.withColumns({f"{m}_cer": rounded(cer(gt, F.col(p))) for m, p in METHODS.items()})
    rows = rows.withColumns({f"{m}_critical": critical(F.col(f"{m}_cer"), F.col(p)) for m, p in METHODS.items()})
    return rows.withColumns({"duration_bucket": duration_bucket(F.col("duration")), "zero_shot_bucket": zero_shot_bucket(F.col("zero_shot_cer"), F.col("zero_shot_critical"))})


PIECES_SQL = f"""
p0 AS (SELECT doc_id, source, lang, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') words FROM documents),
p AS (SELECT doc_id, source, lang, unnest(range(0, (len(words) + {WORDS - 1}) // {WORDS})) n, words FROM p0 WHERE len(words) > 0),
pc AS (SELECT doc_id, source, lang, n, array_to_string(words[n * {WORDS} + 1 : n * {WORDS} + {WORDS}], ' ') gt FROM p)"""

_BYTES = " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 27)))


def one_byte(expr: str) -> str:
    """An expression's text with a byte for each character."""
    return f"translate({expr}, '{ACCENTED}', {_BYTES})"


def distance(a: str, b: str) -> str:
    """DuckDB's edit distance by characters."""
    return f"levenshtein({one_byte(a)}, {one_byte(b)})"


_DURATION = "CASE WHEN duration IS NULL THEN 'missing' WHEN duration <= 0 THEN 'zero' WHEN duration < 2 THEN 'very_short' WHEN duration < 5 THEN 'short' WHEN duration < 10 THEN 'medium' WHEN duration < 20 THEN 'long' ELSE 'very_long' END"
_CER = ", ".join(f"round_even({distance("gt", p)}::DOUBLE / greatest(length(gt), 1), 6) {m}_cer" for m, p in METHODS.items())
_CRITICAL = ", ".join(f"(trim({p}) = '' OR {m}_cer >= 0.5) {m}_critical" for m, p in METHODS.items())
UTTERANCES_SQL = f"""{PIECES_SQL},
u0 AS (SELECT doc_id * 100000 + n utt_id, source speaker_id, lang disease_tag, (doc_id % 7 + 1) * length(gt) / 30.0::DOUBLE duration,
  CASE doc_id % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'dev' ELSE 'train' END split, gt,
  CASE (doc_id + n) % 5 WHEN 0 THEN gt WHEN 1 THEN replace(gt, 'e', 'a') WHEN 2 THEN substr(gt, 1, 40) WHEN 3 THEN '' ELSE reverse(gt) END zero_pred,
  CASE (doc_id + n) % 4 WHEN 0 THEN gt WHEN 1 THEN replace(gt, 't', 'd') WHEN 2 THEN substr(gt, 1, 60) ELSE replace(gt, ' ', '') END base_pred,
  CASE (doc_id + n) % 6 WHEN 1 THEN substr(gt, 1, 50) WHEN 2 THEN '' WHEN 3 THEN replace(gt, 'n', 'm') WHEN 5 THEN reverse(gt) ELSE gt END new_pred FROM pc),
u1 AS (SELECT *, {_CER} FROM u0), u2 AS (SELECT *, {_CRITICAL} FROM u1),
u AS (SELECT *, {_DURATION} duration_bucket, CASE WHEN zero_shot_critical OR zero_shot_cer >= 0.5 THEN 'hard' WHEN zero_shot_cer < 0.2 THEN 'easy' ELSE 'medium' END zero_shot_bucket FROM u2)"""

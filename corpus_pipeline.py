"""Corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes the documents that its predecessor kept; ``run`` writes every stage's rows and reads them again, so each
stage works on stored data and survives lost executors. Stages decide on rows: a row is known by its id and its text, so
rows that share an id, or have none, stand or fall by their own text. Null texts count as empty and are never rejected;
repeated rows share a verdict; further columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import Scratch, broadcast_if_small, free_prefix, table
from talus.llm.decontaminate import contamination
from talus.llm.line_dedup import delete_repeated_lines
from talus.llm.minhash import near_duplicates
from talus.llm.packing import pack_documents
from talus.llm.queries import tokenizer_path
from talus.llm.toxicity import score_toxicity

def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text, and the key's name, which no column has; a missing id differs from any text of one."""
    key, text = f"{free_prefix(docs)}row_key", F.md5(F.coalesce("text", F.lit("")))
    return docs.withColumn(key, F.concat(text, F.coalesce(F.concat(F.lit("-"), F.col("doc_id").cast("string")), F.lit("")))), key


def _without(keyed: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """Rows whose key is not rejected."""
    keys = rejected.select(F.col(rejected.columns[0]).alias(key)).distinct()
    return keyed.join(broadcast_if_small(keys, 16), key, "left_anti").drop(key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Empty texts have the score of a neutral window, which is kept unless nearly all labels are toxic; ties are scored alike.
    """
    keyed, key = _keyed(docs)
    scored = score_toxicity(keyed, table(spark, sf_dir, "labels"), key_col=key)
    return _without(keyed, key, scored.filter("predicted = 1").select(key))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts; documents of which no line remains go.

    Of equal runs the first in order of id and line stays, null ids last. Rows equal in id and text are one document and all
    stay. Empty and blank texts lose nothing and stay as they are; ``n_chars`` follows a changed text.
    """
    out = delete_repeated_lines(docs).filter("NOT (__n_removed > 0 AND __n_removed = __n_lines)")
    return out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays.

    A row without an id yields to any with one; where no row of a group has an id, they all stay, as do empty texts.
    """
    keyed, key = _keyed(docs)
    found = near_duplicates(keyed, words=5, percent=80, key_col=key)
    return _without(keyed, key, found.filter("NOT kept").select(key))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; items without words reject nothing."""
    keyed, key = _keyed(docs)
    found = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(keyed, key, found.filter("contaminated").select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048; an empty text is its end id alone, and repeated rows are packed as often as they occur."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained model and a tokenizer decide on rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{n}-{name}")
        if n:
            scratch.drop(f"{n - 1}-{STAGES[n - 1][0]}")
    return docs

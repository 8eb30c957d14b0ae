"""A bounded, repeatable sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import Scratch


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    *,
    modulus: int,
    held_out: int,
    per_class: int,
    max_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts, labels, and how many labelled rows each class has in all.

    Of each class at most ``per_class`` documents, first by a hash of the id, and at most ``max_bytes`` / 2 of text; a text
    that would pass the bound is left out whole. Rows whose ``id_bucket`` is ``held_out``, null ids and labels other than
    0 and 1 are never read, nor are labels of documents that do not exist. An id labelled twice has its larger label; of repeated ids one text is taken.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "labelled")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & (id_bucket(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
    )
    known = scratch.save(known, "known")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    picked = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    # at most two times per_class ids are broadcast
    found = scratch.save(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")), "texts")
    place = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    sizes = found.select("doc_id", "y", F.octet_length("text").alias("size"), place.alias("place")).collect()
    room, chosen = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
            chosen.append((r["doc_id"],))
    wanted = F.broadcast(spark.createDataFrame(chosen, found.select("doc_id").schema))
    taken = found.join(wanted, "doc_id").select("y", "text", "doc_id", place.alias("place")).coalesce(1).sortWithinPartitions("place", "doc_id").select("y", "text")
    out, y = [], []
    for r in taken.toLocalIterator():  # so that the driver's Python holds each text once
        out.append(r["text"])
        y.append(r["y"])
    scratch.drop("known", "texts")
    return out, y, counts

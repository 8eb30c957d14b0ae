"""Exact deduplication by 128-bit content hash, with byte comparison inside the groups of equal hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, ascii_lower


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = F.md5,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows group by a 128-bit hash of the normalised text. Only texts of hashes that occur more than once are compared:
    they are grouped by hash and bytes, so that equal copies collapse within each task before anything is shuffled, and
    different texts under one hash fall apart. ``keep`` is "min" or "max": the smallest or the largest id stays.

    Defined cases: a null text counts as empty, and empty texts are equal to each other. Rows that share an id share a
    verdict, and each counts in group_size. Null ids lose to others; a group of null ids only keeps its rows. Further
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    best = {"min": F.min, "max": F.max}[keep]
    scratch = Scratch(spark, "exact")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")
    ).withColumn("h", digest("norm"))

    keys = scratch.save(rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "keys")
    repeated = scratch.save(keys.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    n_repeated = repeated.count()
    if n_repeated * 64 <= broadcast_limit:
        again = rows.join(F.broadcast(repeated), "h", "left_semi")
    else:
        again = rows
    by_bytes = again.groupBy("h", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.save(by_bytes.select("h", F.unhex(F.sha2("norm", 256)).alias("g_sha"), "keep_id", "group_size"), "groups")
    collided = scratch.save(groups.groupBy("h").count().filter("count > 1").select("h"), "collided")

    if collided.isEmpty():
        found = keys.join(groups.drop("g_sha"), "h", "left")
    else:  # different texts under one hash: these rows meet their group by their bytes
        apart = (
            rows.join(collided, "h", "left_semi")
            .withColumn("sha", F.unhex(F.sha2("norm", 256)))
            .join(by_bytes.join(collided, "h", "left_semi"), ["h", "norm"])
            .select("h", "doc_id", "sha", "keep_id", "group_size")
        )
        plain = keys.join(collided, "h", "left_anti").join(groups.drop("g_sha"), "h", "left")
        found = plain.unionByName(apart)
    found = found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return found.select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""Repeatable samples."""

from __future__ import annotations

import random
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.shared import ranked


def chance(key: str, seed: int) -> Column:
    """A row's place in a shuffled order, from its key and the seed alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """``n`` rows in a shuffled order that depends on ids and seed alone, not on partitions."""
    return df.orderBy(chance(key, seed), key).limit(n)


def driver_shuffle(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """The first ``n`` rows after a seeded shuffle of the sorted ids by Python's generator.

    Ids stay on the cluster, numbered in order; the driver shuffles their places, four bytes each, and sends back ``n``.
    """
    numbered = ranked(df.select(key).distinct(), key, name="__place")
    places = array("I", range(numbered.count()))
    random.Random(seed).shuffle(places)
    wanted = df.sparkSession.createDataFrame([(at, place + 1) for at, place in enumerate(places[:n])], "__at long, __place long")
    return df.join(numbered.join(F.broadcast(wanted), "__place").drop("__place"), key).orderBy("__at").drop("__at")


def edges_and_sample(df: DataFrame, n: int, key: str, split: str = "split", seed: int = 7) -> DataFrame:
    """The first and the last row of each split, and a hash sample of the rest, ``n`` rows in all."""
    row = F.struct(*[F.col(c) for c in df.columns])
    both = df.groupBy(split).agg(F.array_distinct(F.array(F.min_by(row, key), F.max_by(row, key))).alias("r"))
    edges = both.select(F.explode("r").alias("r")).select("r.*")
    rest = df.join(edges.select(key), key, "left_anti").withColumn("__edge", F.lit(1))
    ordered = edges.withColumn("__edge", F.lit(0)).unionByName(rest)
    return ordered.orderBy("__edge", chance(key, seed), key).limit(n).drop("__edge")


def pick_demo(df: DataFrame, per_split: int, *, key: str = "utt_id", speaker: str = "speaker_id", bucket: str = "zero_shot_bucket", order: tuple[str, ...] = ("hard", "medium", "easy"), seed: int = 7, usable: Column | None = None) -> DataFrame:
    """Per split, rows of distinct speakers in order of bucket; further rows of the same speakers fill what is missing.

    Only rows for which ``usable`` holds take part, such as those whose audio exists.
    """
    df = df if usable is None else df.filter(usable)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket)), F.lit(99))
    rows = df.withColumn("__rank", F.when(rank == 0, 99).otherwise(rank)).withColumn("__h", chance(key, seed))
    turn = F.row_number().over(Window.partitionBy("split", speaker).orderBy("__rank", "__h", key))
    heads = rows.withColumn("__turn", turn).filter(F.col("__turn") <= per_split)
    place = F.row_number().over(Window.partitionBy("split").orderBy("__turn", "__rank", "__h", key))
    return heads.withColumn("__n", place).filter(F.col("__n") <= per_split).drop("__rank", "__h", "__turn", "__n")


def longest(df: DataFrame, n: int, duration: str = "duration", key: str = "utt_id") -> DataFrame:
    """The ``n`` rows of the longest duration, blank ones last, by key on ties."""
    return df.orderBy(F.col(duration).desc_nulls_last(), key).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order; all rows where ``n`` is 0 or less."""
    return df.orderBy(*order).limit(n) if n > 0 else df

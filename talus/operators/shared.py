"""Lineage cuts in the folder that the cluster shares, numbering without one task for all rows, and dealing out small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of the warehouse where that is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (known or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


class Workspace:
    """Tables of one operation, written and read again: a later loss of executors recomputes nothing before them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/talus-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as there are cores at least; a table read in more splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().executedPlan().execute().getNumPartitions()
    return df if splits >= cores else df.repartition(cores, *keys)


#: Bytes of a table that is broadcast once it has been counted.
BROADCAST_BYTES = 16 << 20


def counted_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint where its rows are few enough; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def salted(rows: DataFrame, key: str, most: int, by: str, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``__salt``, and the keys of more than ``most`` rows, with ``__copies``, by how many salts their rows are dealt out."""
    many = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    many = work.save(many.select(key, F.ceil(F.col("__n") / most).alias("__copies")), name)
    found = rows.join(counted_broadcast(many, 32), key, "left")
    return found.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), "__copies"), F.lit(0).cast("long"))).drop("__copies"), many


def copied(rows: DataFrame, key: str, many: DataFrame) -> DataFrame:
    """``rows``, one a key, once for each salt of its key, to meet ``salted`` rows on key and ``__salt``."""
    found = rows.join(counted_broadcast(many, 32), key, "left")
    return found.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1).cast("long")) - 1))).drop("__copies")


def ranked(df: DataFrame, *order: str | Column, name: str = "row_no") -> DataFrame:
    """``df`` with its places in an order, from 1. Ranges of the order are sorted apart and numbered by their offsets.

    The order should be total; equal rows are numbered in any order. Only one number for each range meets in one task. The
    ranges are a written copy of ``df``, which the result reads; it stays until the shared folder is cleaned.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = Workspace(df.sparkSession).save(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    placed = ranged.withColumn("__nth", inside).join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, (F.col("__offset") + F.col("__nth")).cast("long")).drop("__range", "__nth", "__offset")

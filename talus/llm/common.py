"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import string
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator broadcasts after having measured it.
BROADCAST_LIMIT = 16 << 20

_fallback_dir: dict[str, str] = {}


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the vectorised ``lower``; other text is translated letter by letter."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of the warehouse where unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dir:
        _fallback_dir[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared/{app}"
    return _fallback_dir[app]


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor.

    A table that a returned DataFrame still reads stays until ``drop`` is called or the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/talus-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Few rows to an Arrow batch while whole texts go to Python; holds for what is executed inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over batches, after which memory is released: later stages run in the same Python workers."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release_memory()

    return run


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column's name begins with, for inner columns beside all of ``df``."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether a table is proven to stay under the broadcast limit: ``row_bytes`` a row, and what its texts and arrays measure."""
    sizes = [F.sum(F.octet_length(F.col(f"`{f.name}`").cast("string"))) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "struct")]
    found = df.agg(F.count("*").alias("n"), *sizes).first()
    return found["n"] * row_bytes + sum(x or 0 for x in found[1:]) <= limit


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint where its measured size allows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df


def with_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null, keeping the left side's key columns."""
    aliases = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(aliases)
    cond = None
    for k, alias in aliases.items():
        one = left[k].eqNullSafe(renamed[alias])
        cond = one if cond is None else cond & one
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*aliases.values())


def salted(rows: DataFrame, key: str, most: int, by: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``__salt``, and the keys that have more than ``most`` rows, with ``__copies``: so many salts deal their rows out.

    Rows of such a key are told apart by ``by``; all others have the salt 0. There are fewer than rows / ``most`` of these keys.
    Rows without a key meet no row of the other side and are dealt out too.
    """
    many = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    many = scratch.save(many.select(key, F.ceil(F.col("__n") / most).alias("__copies")), name)
    found = rows.join(broadcast_if_small(many, 32), key, "left")
    copies = F.when(F.col(key).isNull(), F.lit(1000).cast("long")).otherwise(F.col("__copies"))
    return found.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), copies), F.lit(0).cast("long"))).drop("__copies"), many


def copied(rows: DataFrame, key: str, many: DataFrame) -> DataFrame:
    """``rows``, one a key, once for each salt of the key: the other side of a join with ``salted`` rows on key and ``__salt``."""
    found = rows.join(broadcast_if_small(many, 32), key, "left")
    return found.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1).cast("long")) - 1))).drop("__copies")

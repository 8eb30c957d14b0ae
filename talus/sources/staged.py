"""Tables that are rewritten in stages: a new version is written beside the old one and a pointer moved at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.sources.tables import file_system, json_lines, read_jsonl


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that a pointer was written for, in order."""
    fs, folder = file_system(spark, f"{path}/_current")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []


def publish(df: DataFrame, path: str) -> int:
    """Publishes rows as JSON lines, as ``publish_lines`` does."""
    return publish_lines(json_lines(df), path)


def publish_lines(lines: DataFrame, path: str) -> int:
    """Writes the column ``value`` as the table's next version and moves the pointer to it; returns the version.

    The pointer is one empty file made after the version is whole. A store makes it for one writer only, so of two
    rewrites at the same time one fails and the other stands. Before that, readers see the old version.
    """
    spark = lines.sparkSession
    version = max(versions(spark, path), default=-1) + 1
    lines.write.mode("overwrite").text(f"{path}/version={version:06d}")  # what a failed rewrite has left is replaced
    fs, pointer = file_system(spark, f"{path}/_current/{version}")
    if not fs.createNewFile(pointer):
        raise RuntimeError(f"version {version} of {path} was published by another writer")
    return version


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the latest version; bytes that are no UTF-8 are read as the replacement character."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of {path} is published")
    return read_jsonl(spark, f"{path}/version={known[-1]:06d}", schema)


def rewrite(spark: SparkSession, path: str, schema, change: Callable[[DataFrame], DataFrame], keep: int = 2) -> int:
    """Reads the latest version, applies ``change`` and publishes the result. Versions older than the last ``keep`` are deleted.

    If ``change`` or the writing fails, the latest version is as it was.
    """
    version = publish(change(current(spark, path, schema)), path)
    for old in versions(spark, path)[:-keep]:
        for part in (f"{path}/_current/{old}", f"{path}/version={old:06d}"):
            fs, found = file_system(spark, part)
            fs.delete(found, True)
    return version

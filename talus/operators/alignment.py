"""Warping paths and alignment of frame sequences as relations: a row a frame, a row a step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.frames import dtw, stack, zscore


def frame_rows(df: DataFrame, key: str, frames: str) -> DataFrame:
    """key, frame (from 0) and values of each frame of an array column."""
    return df.select(key, F.posexplode(frames).alias("frame", "values")).withColumn("values", F.col("values").cast("array<double>"))


def warping_paths(df: DataFrame, key: str, x: str, y: str, normalise: bool = True) -> DataFrame:
    """key, step, i, j and ``cost``, the path's cost per step: the steps of the cheapest path between two columns of frames.

    Frames are normalised per bin over time first, unless told otherwise. A pair is aligned by one task, Arrow batch by
    batch; what leaves it is a row a step. Pairs of which either side is null or has no frames have no path.
    """
    prepare = zscore if normalise else (lambda a: a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for k, a, b in zip(batch["key"], batch["x"], batch["y"], strict=True):
                path, cost = dtw(prepare(stack(a)), prepare(stack(b)))
                parts.append(pd.DataFrame({"key": k, "step": range(len(path)), "i": path[:, 0], "j": path[:, 1], "cost": cost}))
            if parts:
                yield pd.concat(parts)

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).alias("x"), F.col(y).alias("y")).filter("size(x) > 0 AND size(y) > 0")
    found = rows.mapInPandas(run, "key string, step int, i int, j int, cost double")
    return found.select(F.col("key").cast(df.schema[key].dataType).alias(key), "step", "i", "j", "cost")


def align_frames(source: DataFrame, paths: DataFrame, lengths: DataFrame, key: str, mapped: str = "j") -> DataFrame:
    """key, frame and values: ``source`` (rows of frames) on a target's timeline of ``lengths`` (key, length) frames.

    A path's steps say which frames of the source are ``mapped`` to target frame ``i``; a target frame has their mean, bin by bin.
    One that has none repeats the one before it; leading ones take the source's first frame. Steps that point outside either
    sequence are left out. A sequence without source frames has no rows.
    """
    steps = paths.select(key, F.col("i").alias("target"), F.col(mapped).alias("frame")).join(lengths, key).filter("target >= 0 AND target < length")
    hit = steps.join(source, [key, "frame"]).select(key, "target", F.posexplode("values").alias("bin", "value"))
    means = hit.groupBy(key, "target", "bin").agg(F.avg("value").alias("value"))
    means = means.groupBy(key, "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda b: b["value"]).alias("values"))
    timeline = lengths.filter("length > 0").select(key, F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("target"))
    along = Window.partitionBy(key).orderBy("target").rowsBetween(Window.unboundedPreceding, 0)  # one sequence's frames
    filled = timeline.join(means, [key, "target"], "left").withColumn("values", F.last("values", ignorenulls=True).over(along))
    found = filled.filter("values IS NOT NULL")
    leading = filled.filter("values IS NULL").drop("values").join(source.filter("frame = 0"), key).select(key, "target", "values")
    return found.unionByName(leading).withColumnRenamed("target", "frame")

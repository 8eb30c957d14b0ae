"""Padded batches of frame sequences, and losses over their real frames, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.shared import ranked


def length_batches(df: DataFrame, key: str, frames: str, size: int) -> DataFrame:
    """``df`` with n_frames, batch and place: sequences in order of length and key, ``size`` to a batch.

    Neighbours in that order have nearly equal lengths, so padding stays small. Places come from sorted ranges, so no task
    holds all rows. Sequences that are null or have no frames are in no batch.
    """
    rows = df.withColumn("n_frames", F.size(frames).cast("long")).filter("n_frames > 0")
    placed = ranked(rows, "n_frames", key, name="row_no")
    at = F.col("row_no") - 1
    return placed.withColumns({"batch": F.expr(f"(row_no - 1) div {size}"), "place": (at % size).cast("int")}).drop("row_no")


def padded(batches: DataFrame, frames: str, width: int) -> DataFrame:
    """Batches with ``padded``, the frames and frames of zeros up to the batch's longest, ``mask``, which are real, and ``padding``, how many are not."""
    longest = F.max("n_frames").over(Window.partitionBy("batch"))  # a batch's rows
    rows = batches.withColumn("__longest", longest)
    more = (F.col("__longest") - F.col("n_frames")).cast("int")
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), width), more)
    mask = F.transform(F.sequence(F.lit(1), F.col("__longest").cast("int")), lambda i: i <= F.col("n_frames"))
    return rows.withColumns({"padded": F.concat(F.col(frames).cast("array<array<double>>"), blank), "mask": mask, "padding": more.cast("long")}).drop("__longest")


def _ratio(total: Column, count: Column) -> Column:
    return F.coalesce(total, F.lit(0.0)) / F.greatest(count, F.lit(1))


def masked_losses(batches: DataFrame, x: str, y: str, mask: str, *group: str) -> DataFrame:
    """l1 and smoothness of each group of padded rows, over real frames alone, and how many frames and steps are real.

    ``l1`` is the mean absolute difference of the two columns of frames; ``smoothness`` the mean absolute change of the first from a
    frame to the next where both are real. Frames are exploded beside the one before them and summed in part by each task.
    """
    frame = lambda i: F.struct(
        F.get(x, i).alias("a"), F.get(y, i).alias("b"), F.get(mask, i).alias("real"), F.get(x, i - 1).alias("before"), F.coalesce(F.get(mask, i - 1), F.lit(False)).alias("real_before")
    )
    rows = batches.filter(F.size(x) > 0).select(*group, F.explode(F.transform(F.sequence(F.lit(0), F.size(x) - 1), frame)).alias("f")).select(*group, "f.*")
    apart = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v)
    both = F.col("real") & F.col("real_before")
    width = F.size("a")
    out = rows.groupBy(*group).agg(
        F.sum(F.when(F.col("real"), apart("a", "b"))).alias("__l1"), F.sum(F.when(F.col("real"), width)).alias("__cells"), F.count_if("real").alias("n_frames"),
        F.sum(F.when(both, apart("a", "before"))).alias("__steps"), F.sum(F.when(both, width)).alias("__step_cells"), F.count_if(both).alias("n_steps"),
    )
    zero = F.lit(0).cast("long")
    return out.select(*group, _ratio(F.col("__l1"), F.coalesce("__cells", zero)).alias("l1"), _ratio(F.col("__steps"), F.coalesce("__step_cells", zero)).alias("smoothness"), "n_frames", "n_steps")

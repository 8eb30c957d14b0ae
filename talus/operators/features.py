"""Paired features of recorded and reference speech as one operation: features, path, alignment, residual, payloads, manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.frames import align, dtw, interpolate, log_mel, stack, zscore
from talus.functions.metrics import rounded
from talus.operators.dedupe import remaining
from talus.sources.tables import file_system, log_runs

_FRAMES = "array<array<double>>"
PAYLOAD = f"key string, norm {_FRAMES}, aligned {_FRAMES}, residual {_FRAMES}, norm_embedding {_FRAMES}, embedding_aligned {_FRAMES}, path array<struct<i:int,j:int>>, cost double, n_norm int, n_other int, error string"
COLUMNS = [c.split()[0] for c in PAYLOAD.split(", ")]


def paired(norm: np.ndarray, other: np.ndarray, norm_embedding: np.ndarray | None = None, other_embedding: np.ndarray | None = None) -> dict:
    """Arrays of one pair: ``other`` on the timeline of ``norm``, and its residual; embeddings are brought to the features' timelines first."""
    path, cost = dtw(zscore(norm), zscore(other))
    aligned = align(other, path, len(norm))
    out = {"norm": norm, "aligned": aligned, "residual": aligned - norm, "path": path, "cost": cost, "n_norm": len(norm), "n_other": len(other)}
    if norm_embedding is not None and other_embedding is not None:
        out["norm_embedding"] = interpolate(norm_embedding, len(norm))
        out["embedding_aligned"] = align(interpolate(other_embedding, len(other)), path, len(norm))
    return out


def feature_payloads(pairs: DataFrame, key: str, norm: str, other: str, *, features: Callable[[np.ndarray], np.ndarray] | None = log_mel, embeddings: tuple[str, str] | None = None) -> DataFrame:
    """A payload for each pair: arrays, path, cost and lengths; where a pair cannot be done, the error's type and text.

    ``features`` turns a wave into frames; None takes the columns as frames. ``embeddings`` may name two columns of frames more.
    """
    both = embeddings or ()

    def array(value) -> np.ndarray:
        return features(np.asarray(value, float)) if features else stack(value)

    def one(row) -> dict:
        more = [None if x is None else stack(x) for x in row[3:]]
        found = paired(array(row[1]).astype(float), array(row[2]).astype(float), *more)
        found = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in found.items()}
        return found | {"path": [{"i": i, "j": j} for i, j in found["path"]]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                try:
                    out.append(dict.fromkeys(COLUMNS) | one(row) | {"key": row[0], "error": ""})
                except Exception as error:  # noqa: BLE001 recorded with the row
                    out.append(dict.fromkeys(COLUMNS) | {"key": row[0], "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    given = pairs.select(F.col(key).cast("string").alias("key"), F.col(norm).alias("norm"), F.col(other).alias("other"), *[F.col(c) for c in both])
    return given.mapInPandas(run, PAYLOAD).withColumnRenamed("key", key)


def build_features(pairs: DataFrame, key: str, norm: str, other: str, path: str, **options) -> DataFrame:
    """Builds payloads of pairs that have none yet, as a further run below ``path``, and returns the manifest of this run.

    A manifest row has the key, status (``generated``, ``exists`` or ``error``), lengths, path_len, cost, residual_l1, residual_l2
    and the error. Pairs that an earlier run has failed on are tried again. Each run is a folder, whole once it has its mark of
    success; a run that dies leaves nothing that is read.
    """
    spark = pairs.sparkSession
    pairs = pairs.withColumn(key, F.col(key).cast("string"))
    runs = log_runs(spark, path)
    made = None
    if runs:
        made = spark.read.parquet(*[f"{path}/run={n:012d}" for n in runs]).filter("error = ''").select(key)
    left = pairs if made is None else remaining(pairs, made, key)
    number = max(runs, default=-1) + 1
    folder = f"{path}/run={number:012d}"
    fs, place = file_system(spark, folder)
    fs.delete(place, True)  # what a run that died has left
    feature_payloads(left, key, norm, other, **options).write.parquet(folder)
    rows = spark.read.parquet(folder)
    cells = F.flatten("residual")
    n = F.greatest(F.size(cells), F.lit(1))
    l1 = F.aggregate(cells, F.lit(0.0), lambda s, v: s + F.abs(v)) / n
    l2 = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, v: s + v * v) / n)
    out = rows.select(
        key, F.when(F.col("error") == "", "generated").otherwise("error").alias("status"), "n_norm", "n_other", F.when(F.col("path").isNotNull(), F.size("path")).alias("path_len"),
        rounded(F.col("cost")).alias("cost"), rounded(l1).alias("residual_l1"), rounded(l2).alias("residual_l2"), "error",
    )
    if made is None:
        return out
    there = pairs.select(key).join(made.distinct(), key, "left_semi").select(key, F.lit("exists").alias("status"))
    return out.unionByName(there.withColumn("error", F.lit("")), allowMissingColumns=True)

"""Batch inference through a pluggable function, with retries by row and resumption."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.dedupe import remaining


class Transcriber(Protocol):
    def transcribe(self, inputs: list[str]) -> list[str]:
        """One output for each input; raises if the batch cannot be done."""


def batch_infer(df: DataFrame, make: Callable[[], Transcriber], *, key: str, source: str, batch: int = 8) -> DataFrame:
    """key, pred, inference_error and inference_time_sec. A model is made once per task.

    A batch that fails is tried again row by row; a row that fails has a blank prediction and the error's type and text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                inputs, began = part["source"].tolist(), time.monotonic()
                try:
                    results = [(p, "") for p in model.transcribe(inputs)]
                except Exception:  # noqa: BLE001 a model may raise anything; rows are tried one at a time below
                    results = []
                    for one in inputs:
                        try:
                            results.append((model.transcribe([one])[0], ""))
                        except Exception as error:  # noqa: BLE001 recorded with the row
                            results.append(("", f"{type(error).__name__}: {error}"))
                took = time.monotonic() - began
                rows += [(k, p, e, took) for k, (p, e) in zip(part["key"], results, strict=True)]
            yield pd.DataFrame(rows, columns=["key", "pred", "inference_error", "inference_time_sec"])

    out = df.selectExpr(f"cast(`{key}` as string) key", f"`{source}` source").mapInPandas(run, "key string, pred string, inference_error string, inference_time_sec double")
    return out.withColumnRenamed("key", key)


def resume_infer(df: DataFrame, done: DataFrame | None, make: Callable[[], Transcriber], *, key: str, source: str, path: str, run: str, batch: int = 8) -> DataFrame:
    """Runs what is not yet done and writes it to the folder of this ``run`` below ``path``; returns all results there.

    A run that is repeated after a failure replaces its own folder, so no row is there twice.
    """
    left = df if done is None else remaining(df, done, key)
    batch_infer(left, make, key=key, source=source, batch=batch).write.mode("overwrite").parquet(f"{path}/run={run}")
    return df.sparkSession.read.parquet(path).drop("run")


def infer_or_fail(df: DataFrame, make: Callable[[], Transcriber], *, key: str, source: str, batch: int = 8) -> DataFrame:
    """key and pred; the first error of a model ends the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            out = []
            for start in range(0, len(frame), batch):
                out += model.transcribe(frame["source"].iloc[start : start + batch].tolist())
            yield pd.DataFrame({"key": frame["key"], "pred": out})

    out = df.selectExpr(f"cast(`{key}` as string) key", f"`{source}` source").mapInPandas(run, "key string, pred string")
    return out.withColumnRenamed("key", key)


class Embedder(Protocol):
    def embed(self, inputs: list[str]) -> list[list[list[float]]]:
        """Frames of vectors for each input."""


def extract_frames(df: DataFrame, make: Callable[[], Embedder], *, key: str, source: str, batch: int = 8) -> DataFrame:
    """key and frames, by a model that is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            out = []
            for start in range(0, len(rows), batch):
                out += model.embed(rows["source"].iloc[start : start + batch].tolist())
            yield pd.DataFrame({"key": rows["key"], "frames": out})

    out = df.selectExpr(f"cast(`{key}` as string) key", f"`{source}` source").mapInPandas(run, "key string, frames array<array<double>>")
    return out.withColumnRenamed("key", key)


class Synthesizer(Protocol):
    def speak(self, text: str) -> bytes:
        """Audio of one text."""


def synthesize(df: DataFrame, existing: DataFrame, make: Callable[[], Synthesizer], *, key: str, text: str, overwrite: bool = False) -> DataFrame:
    """key, status (exists, generated or error), audio (null unless generated) and error, for each row.

    Rows whose key is in ``existing`` are not spoken again unless ``overwrite``; a row that fails is recorded and the rest go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            out = []
            for one, known, words in zip(rows["key"], rows["known"], rows["text"], strict=True):
                if known:
                    out.append((one, "exists", None, ""))
                    continue
                try:
                    out.append((one, "generated", model.speak(words or ""), ""))
                except Exception as error:  # noqa: BLE001 recorded with the row
                    out.append((one, "error", None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["key", "status", "audio", "error"])

    done = existing.select(key).distinct().withColumn("known", F.lit(not overwrite))
    rows = df.join(done, key, "left").select(F.col(key).cast("string").alias("key"), F.coalesce("known", F.lit(False)).alias("known"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, status string, audio binary, error string").withColumnRenamed("key", key)


def smoke(spark: SparkSession, make: Callable[[], Transcriber], source: str) -> str:
    """The output for one input, by the same path as a whole table."""
    return infer_or_fail(spark.createDataFrame([("0", source)], "key string, source string"), make, key="key", source="source").first()["pred"]

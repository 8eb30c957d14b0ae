"""Discovery of audio files and their transcripts, and what their headers and samples say."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions.frames import loudness, resample
from talus.operators.shared import counted_broadcast

HEADER = T.StructType([T.StructField(n, t) for n, t in (("frames", T.LongType()), ("sample_rate", T.IntegerType()), ("channels", T.IntegerType()), ("duration_sec", T.DoubleType()), ("error", T.StringType()))])


def wav_chunks(data: bytes) -> tuple[tuple, bytes]:
    """The format fields and the sample bytes of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, samples = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            samples = body
        at += 8 + size + size % 2
    if form is None or samples is None:
        raise ValueError("no format or data chunk")
    return form, samples


def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples between -1 and 1, and their rate."""
    (kind, channels, rate, _, _, bits), raw = wav_chunks(data)
    if kind == 3 and bits == 32:
        x = np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").astype(float)
    elif bits == 16:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    else:
        raise ValueError(f"unsupported format {kind}, {bits} bits")
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


@F.pandas_udf(HEADER)
def wav_header(contents: pd.Series) -> pd.DataFrame:
    """Frames, rate, channels and seconds; blank with an error for what cannot be read."""
    out = []
    for data in contents:
        try:
            (_, channels, rate, _, block, _), raw = wav_chunks(data)
            frames = len(raw) // max(block, 1)
            out.append((frames, rate, channels, round(frames / rate, 3), None))
        except (ValueError, struct.error, ZeroDivisionError) as error:
            out.append((None, None, None, None, f"{type(error).__name__}: {error}"))
    return pd.DataFrame(out, columns=[f.name for f in HEADER])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def wav_mono(contents: pd.Series, rates: pd.Series) -> pd.Series:
    return pd.Series([resample(*wav_samples(data), int(rate)).tolist() for data, rate in zip(contents, rates, strict=True)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def normalize_loudness(waves: pd.Series) -> pd.Series:
    return waves.map(lambda w: loudness(np.asarray(w)).tolist())


def discover(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """One row per file: path, rel_path, speaker, session (only below a speaker's folder), audio_id, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    clean = root.rstrip("/").removeprefix("file:").lstrip("/")
    parts = F.split(F.col("rel_path"), "/")
    rel = F.substring_index(F.col("path"), clean + "/", -1)
    return files.withColumn("rel_path", rel).select(
        "path", "rel_path", parts[0].alias("speaker"), F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("session"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("audio_id"), "length", "content",
    )


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Rows ``folder``, ``name``, ``text`` of all transcript tables: cut at the first comma; header and other lines skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "transcript.txt").text(root)
    lines = lines.select("value", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"))
    rows = lines.filter(F.col("value").contains(",") & (F.trim("value") != "filename,transcript"))
    return rows.select("folder", F.regexp_extract("value", "^([^,]*),", 1).alias("name"), F.trim(F.regexp_extract("value", "^[^,]*,(.*)$", 1)).alias("text"))


def labels(spark: SparkSession, root: str) -> DataFrame:
    """Rows ``stem_path`` and ``text`` of label files beside the audio."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.lab").option("wholetext", True).text(root)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.lab$", "").alias("stem_path"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"))


def with_transcripts(files: DataFrame, lab: DataFrame, table: DataFrame) -> DataFrame:
    """Adds gt and gt_source: a label file comes before a transcript table."""
    rows = files.withColumns({"stem_path": F.regexp_replace("path", r"\.[^./]*$", ""), "folder": F.regexp_replace("path", "/[^/]*$", ""), "name": F.element_at(F.split("path", "/"), -1)})
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    lab = lab.select(same(F.col("stem_path")).alias("stem_path"), F.col("text").alias("__lab"))
    table = table.select(same(F.col("folder")).alias("folder"), "name", F.col("text").alias("__row"))
    rows = rows.withColumns({"stem_path": same(F.col("stem_path")), "folder": same(F.col("folder"))}).join(lab, "stem_path", "left").join(table, ["folder", "name"], "left")
    source = F.when(F.col("__lab").isNotNull(), ".lab").when(F.col("__row").isNotNull(), "transcript.txt").otherwise("")
    return rows.withColumns({"gt": F.coalesce("__lab", "__row", F.lit("")), "gt_source": source}).drop("__lab", "__row", "stem_path", "folder", "name")


def paired_labels(files: DataFrame, lab: DataFrame) -> DataFrame:
    """Audio files with the text of the label file beside each as ``gt``; a file without one is an error, as is an empty folder."""
    from talus.operators.dedupe import require_empty, require_rows

    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = require_rows(files, "audio folder").withColumn("stem_path", same(F.regexp_replace("path", r"\.[^./]*$", "")))
    lab = lab.select(same(F.col("stem_path")).alias("stem_path"), F.col("text").alias("gt"))
    require_empty(rows.join(lab, "stem_path", "left_anti").select("path").orderBy("path"), "audio without a label file")
    return rows.join(lab, "stem_path").drop("stem_path")


def checkpoint_folders(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of the folders in ``root``, from a listing by Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return spark.createDataFrame([(f.getPath().toString(),) for f in found if f.isDirectory()], "path string")


def retention(paths: DataFrame, best: DataFrame, column: str = "path") -> DataFrame:
    """``path``, ``step`` and ``keep`` of folders named checkpoint-N: the best step stays. A report; nothing is deleted.

    ``best`` has a row a run.
    """
    step = F.regexp_extract(column, r"checkpoint-(\d+)$", 1).try_cast("long")
    rows = paths.withColumn("step", step).filter("step is not null")
    kept = best.select(F.col("best_step").cast("long").alias("step"), F.lit(True).alias("keep"))
    return rows.join(counted_broadcast(kept.distinct(), 16), "step", "left").select(column, "step", F.coalesce("keep", F.lit(False)).alias("keep"))


def latest_checkpoint(paths: DataFrame, column: str = "path") -> DataFrame:
    """Of folders named checkpoint-N, the one with the largest N."""
    step = F.regexp_extract(column, r"checkpoint-(\d+)$", 1).try_cast("long")
    return paths.withColumn("step", step).filter("step is not null").agg(F.max_by(column, "step").alias(column), F.max("step").alias("step"))


def missing_files(rows: DataFrame, column: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is not in a listing, which is read once for all rows."""
    return rows.join(listing.select(F.col("path").alias(column)).distinct(), column, "left_anti")

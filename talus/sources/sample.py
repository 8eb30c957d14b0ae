"""A small tree of audio files for the scan query and tests, written through Hadoop's file system."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession


def wav_bytes(samples: list[int], rate: int = 16000, channels: int = 1) -> bytes:
    body = struct.pack(f"<{len(samples)}h", *samples)
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def write_sample_tree(spark: SparkSession, root: str) -> None:
    for name, data in {"a_HD/s1/u1.wav": wav_bytes([0] * 16000), "a_HD/s1/u2.wav": wav_bytes([100, -100] * 4000, channels=2), "b/u3.wav": b"broken"}.items():
        write_file(spark, f"{root}/{name}", data)

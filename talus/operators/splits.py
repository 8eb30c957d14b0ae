"""Scoring and searching splits of groups, and audits of a split."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "dev", "test")
# Weights of a penalty: sizes, shares of a field's values, and what dev and test should hold at least.
SIZE_WEIGHT, FIELD_WEIGHTS = 20.0, {"zero_shot_bucket": 7.0, "duration_bucket": 3.0, "disease_tag": 2.0}
LEAST = {"speakers": (25, 1.0), "hard": (35, 0.3), "focal": (3, 2.0)}


def split_sizes(groups: int, ratios: tuple[float, float, float]) -> dict[str, int]:
    """Groups per split; dev and test are rounded half to even, the rest is train."""
    dev, test = round(groups * ratios[1]), round(groups * ratios[2])
    return {"train": groups - dev - test, "dev": dev, "test": test}


def score_split(df: DataFrame, ratios: tuple[float, float, float], focal_speaker: str = "", split: str = "split", weights: dict[str, float] | None = None) -> DataFrame:
    """One row, ``score``: how far a split is from its sizes, from the corpus' shares, and from its least contents.

    Shares come from one aggregation per field and split; nothing but counts is gathered.
    """
    weights = FIELD_WEIGHTS if weights is None else weights
    spark = df.sparkSession
    frame = spark.createDataFrame([(s, float(r)) for s, r in zip(SPLITS, ratios, strict=True)], "split string, ratio double")
    per_split = df.groupBy(F.col(split).alias("split")).agg(
        F.count("*").alias("n"), F.count_distinct("speaker_id").alias("speakers"), F.count_if(F.col("zero_shot_bucket") == "hard").alias("hard"),
        F.count_if(F.col("speaker_id") == focal_speaker).alias("focal"),
    )
    total = df.agg(F.count("*").alias("total"))
    sizes = frame.join(per_split, "split", "left").na.fill(0).crossJoin(total)  # three rows
    target = F.col("total") * F.col("ratio")
    penalty = SIZE_WEIGHT * F.abs(F.col("n") - target) / F.greatest(F.lit(1.0), target)
    for name, (least, weight) in LEAST.items():
        penalty = penalty + F.when(F.col("split") != "train", F.greatest(F.lit(0), least - F.col(name)) * weight).otherwise(0.0)
    score = sizes.agg(F.sum(penalty).alias("s"))
    for field, weight in weights.items():
        counts = df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("value"), F.col(split).alias("split")).agg(F.count("*").alias("k"))
        whole = counts.groupBy("value").agg(F.sum("k").alias("all")).crossJoin(sizes.select("split", "n", "total"))  # values times three
        shares = whole.join(counts, ["value", "split"], "left").na.fill(0, ["k"])
        part = weight * F.abs(F.col("k") / F.greatest(F.col("n"), F.lit(1)) - F.col("all") / F.col("total"))
        score = score.unionByName(shares.agg(F.sum(part).alias("s")))
    return score.agg(F.sum("s").alias("score"))


def search_split(df: DataFrame, group: str, ratios: tuple[float, float, float], *, seed: int = 7, trials: int = 30_000, focal_speaker: str = "", chunk: int = 1000) -> DataFrame:
    """Best of ``trials`` random assignments of groups to splits: group, split and score; the first of equals.

    Groups are reduced to count vectors before anything reaches the driver. One random stream makes the orders, so trials do
    not depend on the cluster: the driver runs through it and keeps the generator's state every ``chunk`` trials, and tasks
    replay a chunk each and score it. What the driver and the tasks hold grows with the number of groups, not of trials.
    """
    spark = df.sparkSession
    fields = list(FIELD_WEIGHTS)
    keyed = df.select(F.col(group).cast("string").alias("g"), F.col("speaker_id").cast("string").alias("speaker"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields])
    counts = keyed.groupBy("g", "speaker", *fields).agg(F.count("*").alias("n")).toPandas().sort_values(["g", "speaker", *fields])
    names = sorted(counts["g"].unique())
    at = {g: i for i, g in enumerate(names)}
    row, n = counts["g"].map(at).to_numpy(), counts["n"].to_numpy(float)
    size = np.bincount(row, weights=n, minlength=len(names))
    tables = {f: np.zeros((len(names), counts[f].nunique())) for f in fields}
    for f in fields:
        np.add.at(tables[f], (row, pd.factorize(counts[f], sort=True)[0]), n)
    hard = np.bincount(row, weights=n * (counts["zero_shot_bucket"] == "hard"), minlength=len(names))
    focal = np.bincount(row, weights=n * (counts["speaker"] == focal_speaker), minlength=len(names))
    speakers = np.zeros((len(names), counts["speaker"].nunique()), bool)
    speakers[row, pd.factorize(counts["speaker"])[0]] = True
    wanted, total = split_sizes(len(names), ratios), n.sum()

    def penalty(order: np.ndarray) -> float:
        score, start = 0.0, 0
        for s, ratio in zip(SPLITS, ratios, strict=True):
            part = order[start : start + wanted[s]]
            start += wanted[s]
            rows, target = size[part].sum(), total * ratio
            score += SIZE_WEIGHT * abs(rows - target) / max(1.0, target)
            for f, weight in FIELD_WEIGHTS.items():
                score += weight * np.abs(tables[f][part].sum(axis=0) / max(1.0, rows) - tables[f].sum(axis=0) / total).sum()
            if s != "train":
                held = {"speakers": speakers[part].any(axis=0).sum(), "hard": hard[part].sum(), "focal": focal[part].sum()}
                score += sum(max(0.0, least - held[k]) * weight for k, (least, weight) in LEAST.items())
        return float(score)

    def chunk_of(state: tuple, count: int) -> Iterator[np.ndarray]:
        rng = random.Random()
        rng.setstate(state)
        for _ in range(count):
            places = list(range(len(names)))
            rng.shuffle(places)
            yield np.array(places)

    # one random stream for all trials: the driver keeps its state at each chunk, tasks replay their chunks from there
    rng, states = random.Random(seed), []
    for first in range(0, trials, chunk):
        states.append((first, min(chunk, trials - first), rng.getstate()))
        for _ in range(states[-1][1] if first + chunk < trials else 0):
            rng.shuffle(list(range(len(names))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for first, count, inner in zip(batch["first"], batch["count"], batch["state"], strict=True):
                found = [penalty(order) for order in chunk_of((3, tuple(map(int, inner)), None), int(count))]
                best = int(np.argmin(found))
                rows.append((int(first), best, found[best]))
            yield pd.DataFrame(rows, columns=["first", "nth", "score"])

    given = spark.createDataFrame([(f, n, [*s[1]]) for f, n, s in states], "first long, count long, state array<long>").repartition(len(states), "first")
    best = given.mapInPandas(score, "first long, nth long, score double").agg(F.min_by(F.struct("first", "nth"), F.struct("score", "first")).alias("t"), F.min("score").alias("score")).first()
    lowest, state = best["score"], next(s for f, _, s in states if f == best["t"]["first"])
    order = [*chunk_of(state, best["t"]["nth"] + 1)][-1]
    out, start = [], 0
    for s in SPLITS:
        out += [(names[i], s, lowest) for i in order[start : start + wanted[s]].tolist()]
        start += wanted[s]
    return spark.createDataFrame(out, f"{group} string, split string, score double")


def split_audit(df: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Counts per split in wide form; a split without rows has zeros."""
    frame = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    buckets = ("easy", "medium", "hard")
    found = df.groupBy("split").agg(
        F.count("*").alias("sample_count"), F.count_distinct("speaker_id").alias("speaker_count"),
        *[F.count_if(F.col("zero_shot_bucket") == b).alias(f"zero_{b}") for b in buckets],
        *[F.count_if(F.col("duration_bucket") == b).alias(f"duration_{b}") for b in ("very_short", "short", "medium", "long", "very_long")],
    )
    return frame.join(found, "split", "left").na.fill(0)


def speaker_crosstab(df: DataFrame, splits: tuple[str, ...] = SPLITS, order: str = "utt_id") -> DataFrame:
    """Rows of each speaker by split, the tag of its first row in order, and whether all splits have some."""
    out = df.groupBy("speaker_id").agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits], F.min_by("disease_tag", order).alias("disease_tag"))
    return out.withColumn("in_all", F.least(*[F.col(s) for s in splits]) > 0)

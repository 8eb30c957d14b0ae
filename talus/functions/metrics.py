"""Edit-distance metrics, error flags and buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.text import normalize_full

CRITICAL = 0.5


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance by code points over the reference's length, at least one; may exceed 1."""
    return F.levenshtein(reference, hypothesis).cast("double") / F.greatest(F.length(reference), F.lit(1))


def rounded(c: Column, places: int = 6) -> Column:
    return F.bround(c.cast("double"), places)


def critical(rate: Column, prediction: Column, *, error: Column | None = None, on_rounded: bool = True, threshold: float = CRITICAL) -> Column:
    """Whether a row failed: an inference error, a blank prediction, or a rate from ``threshold`` on.

    ``on_rounded``: whether the rate is rounded to six places first. Pass the raw or the normalised prediction according to
    which of them must be blank.
    """
    rate = rounded(rate) if on_rounded else rate
    out = (F.trim(F.coalesce(prediction, F.lit(""))) == "") | F.coalesce(rate >= threshold, F.lit(False))
    return out if error is None else out | (F.coalesce(error, F.lit("")) != "")


def critical_reason(rate: Column, prediction: Column, *, error: Column | None = None, threshold: float = CRITICAL) -> Column:
    out = F.when(F.trim(F.coalesce(prediction, F.lit(""))) == "", "blank_prediction").when(rounded(rate) >= threshold, f"textnorm_cer>={threshold}").otherwise("")
    return out if error is None else F.when(F.coalesce(error, F.lit("")) != "", "inference_error").otherwise(out)


def duration_bucket(seconds: Column) -> Column:
    out = F.when(seconds.isNull(), "missing").when(seconds <= 0, "zero")
    for limit, name in ((2, "very_short"), (5, "short"), (10, "medium"), (20, "long")):
        out = out.when(seconds < limit, name)
    return out.otherwise("very_long")


def cer_bucket(rate: Column) -> Column:
    return F.when(rate >= CRITICAL, "hard").when(rate < 0.2, "easy").when(rate.isNotNull(), "medium")


def zero_shot_bucket(rate: Column, failed: Column) -> Column:
    return F.when(failed | F.coalesce(rate >= CRITICAL, F.lit(False)), "hard").otherwise(F.coalesce(cer_bucket(rate), F.lit("unknown")))


def movement(before: Column, after: Column) -> Column:
    """Class of a row by its critical flags before and after."""
    return F.when(before & ~after, "Rescued").when(before & after, "Still hard").when(after, "Regression").otherwise("Stable easy")


def dbfs(mean_square: Column) -> Column:
    return 20 * F.log10(F.greatest(F.sqrt(mean_square), F.lit(1e-12)))


def steps_per_epoch(rows: Column, batch: int, accumulation: int) -> Column:
    return F.ceil(rows / F.lit(float(batch * accumulation))).cast("long")


def step_grid(last: Column, every: int) -> Column:
    """Every so many steps, and the last."""
    grid = F.when(last >= every, F.sequence(F.lit(every).cast("long"), last.cast("long"), F.lit(every).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.array_union(grid, F.array(last.cast("long")))


def score_row(df: DataFrame, *, gt: str = "gt", pred: str = "pred", error: str | None = None, normalise: Callable[[Column], Column] = normalize_full, on_raw: bool = True) -> DataFrame:
    """Adds normal_gt, normal_pred, cer, critical and reason: normaliser, distance, rate, flag and reason of a row.

    ``on_raw``: the raw prediction must be blank to fail, and the rounded rate decides; otherwise the normalised prediction
    and the unrounded rate.
    """
    failed = None if error is None else F.col(error)
    out = df.withColumns({"normal_gt": normalise(F.coalesce(gt, F.lit(""))), "normal_pred": normalise(F.coalesce(pred, F.lit("")))})
    rate = cer(F.col("normal_gt"), F.col("normal_pred"))
    blank = F.col(pred) if on_raw else F.col("normal_pred")
    out = out.withColumns({"__rate": rate})
    return out.withColumns(
        {"cer": rounded(F.col("__rate")), "critical": critical(F.col("__rate"), blank, error=failed, on_rounded=on_raw), "reason": critical_reason(F.col("__rate"), blank, error=failed)}
    ).drop("__rate")


def peak(samples: Column) -> Column:
    """The largest magnitude of an array of samples; 0 for none."""
    return F.coalesce(F.array_max(F.transform(samples, lambda v: F.abs(v).cast("double"))), F.lit(0.0))


def mean_square(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.greatest(F.size(samples), F.lit(1))

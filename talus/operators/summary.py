"""Stratified summaries by grouping sets, frequency counts and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.metrics import rounded
from talus.operators.shared import ranked


def plain_mean(c: str | Column) -> Column:
    """Average without nulls and NaN; null without values.

    Values below 10^16 are summed as decimals of twelve places, so a mean is the same in whatever order and parts they are
    added. Where a group holds an infinity or a larger value, it is summed as doubles, so these count like any other.
    """
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    value = F.when(~F.isnan(value), value)
    exact = value.try_cast("decimal(28,12)")
    total = F.when(F.count(exact) == F.count(value), F.try_sum(exact).cast("double"))
    return F.try_divide(F.coalesce(total, F.sum(value)), F.count(value))


def mean(c: str | Column, places: int = 6) -> Column:
    """Average without nulls and NaN, rounded half to even; null without values."""
    return rounded(plain_mean(c), places)


def rate_of_all(flag: str) -> Column:
    """Share of true among all rows; blank counts as false."""
    return rounded(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int")))


def grouping_sets(df: DataFrame, dims: list[str], *aggs: Column, keep_blank: bool = True) -> DataFrame:
    """One aggregation over all rows and over each dimension: group_type, group_value and the aggregates.

    One pass feeds all groups. ``keep_blank``: whether blank values of a dimension are a group of their own.
    """
    marks = [F.grouping(d).alias(f"__g_{d}") for d in dims]
    out = df.groupingSets([[], *[[d] for d in dims]], *dims).agg(*marks, *aggs)
    kind, value = F.lit("overall"), F.lit("all")
    for d in dims:
        kind = F.when(F.col(f"__g_{d}") == 0, d).otherwise(kind)
        value = F.when(F.col(f"__g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit(""))).otherwise(value)
    names = [c for c in out.columns if c not in dims and not c.startswith("__g_")]
    out = out.select(kind.alias("group_type"), value.alias("group_value"), *names)
    return out if keep_blank else out.filter("group_value <> ''")


def label(group_type: Column, group_value: Column) -> Column:
    return F.when(group_type == "overall", "overall").otherwise(F.concat(group_type, F.lit("="), group_value))


def stratified_summary(df: DataFrame, dims: list[str], before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Means, critical rates and counts of two methods, given as (rate, flag) columns, and the differences of means and rates.

    Means leave out blank and NaN rates, critical rates leave out blank flags.
    """
    (b_cer, b_crit), (a_cer, a_crit) = before, after
    share = lambda c: F.avg(F.col(c).cast("int"))  # noqa: E731 a blank flag counts neither way
    out = grouping_sets(
        df, dims, F.count("*").alias("sample_count"), mean(b_cer).alias("before_cer"), mean(a_cer).alias("after_cer"),
        rounded(plain_mean(a_cer) - plain_mean(b_cer)).alias("delta_cer"), rounded(share(b_crit)).alias("before_critical_rate"),
        rounded(share(a_crit)).alias("after_critical_rate"), rounded(share(a_crit) - share(b_crit)).alias("delta_critical_rate"), F.count_if(b_crit).alias("before_critical_count"), F.count_if(a_crit).alias("after_critical_count"),
    )
    return out.select(label(F.col("group_type"), F.col("group_value")).alias("group"), *out.columns[2:])


def performance_long(df: DataFrame, dims: list[str], scope: str) -> DataFrame:
    """Scope, group and counts in long form; rates exclude rows without a flag."""
    out = grouping_sets(
        df, dims, F.count("*").alias("sample_count"), F.count_if(F.col("pred") != "").alias("inferred_count"), mean("cer").alias("avg_cer"),
        rounded(F.avg(F.col("critical").cast("int"))).alias("avg_critical"), F.count_if("critical").alias("critical_count"),
        F.count("critical").alias("critical_labeled"), mean("duration").alias("avg_duration"),
    )
    return out.select(F.lit(scope).alias("scope"), "*")


def speaker_summary(df: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """One row per speaker and one over all."""
    out = df.rollup(speaker).agg(
        F.grouping(speaker).alias("__g"), F.count("*").alias("samples_total"), F.count_if(F.col("pred") != "").alias("inferred_total"),
        F.count_if(F.col("gt") != "").alias("gt_total"), mean("cer").alias("avg_cer"), rounded(F.avg(F.col("critical").cast("int"))).alias("critical_rate"),
        F.count_if("critical").alias("critical_count"), F.count("critical").alias("critical_labeled"),
    )
    return out.withColumn(speaker, F.when(F.col("__g") == 1, "__OVERALL__").otherwise(F.col(speaker))).drop("__g")


def corpus_cer(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per form: summed distances over summed lengths, and how many rows match exactly. One pass, one row a form."""
    aggs = []
    for name, (gt, pred) in pairs.items():
        aggs += [
            F.sum(F.levenshtein(gt, pred).cast("long")).alias(f"{name}__distance"),
            F.sum(F.greatest(F.length(gt), F.lit(1)).cast("long")).alias(f"{name}__length"),
            F.count_if(gt == pred).alias(f"{name}__exact"),
        ]
    wide = df.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("form"), F.col(f"{k}__distance").alias("distance"), F.col(f"{k}__length").alias("length"), F.col(f"{k}__exact").alias("exact")) for k in pairs])
    return wide.select("n", F.explode(rows).alias("r")).select(
        "r.form", "r.distance", "r.length", "r.exact", rounded(F.try_divide("r.distance", "r.length")).alias("cer"), rounded(F.try_divide("r.exact", "n")).alias("exact_rate")
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """How often each tag of an array column occurs; rows without tags do not count."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    """min, p01, p05, mean, median, p95, p99, max; percentiles are exact, with linear interpolation."""
    wanted = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    # values are numbered by sorted ranges, so no task holds them all; of these, two for each percentile are read
    values = ranked(df.select(F.col(column).cast("double").alias("v")).filter("v is not null"), "v", name="r")
    n = F.col("n")
    at = {name: (n - 1) * q + 1 for name, q in wanted.items()}
    total = values.agg(F.count("*").alias("n"))
    near = [f(at[name]).cast("long") for name in wanted for f in (F.floor, F.ceil)]
    picked = values.join(F.broadcast(total), F.array_contains(F.array(*near), F.col("r")))
    points = picked.agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("r", "v")))).alias("__at"))
    out = df.agg(F.min(column).cast("double").alias("min"), F.avg(column).alias("mean"), F.max(column).cast("double").alias("max")).crossJoin(points).crossJoin(total)  # one row each
    named = {}
    for name, place in at.items():
        low, high = (F.try_element_at("__at", f(place).cast("long")) for f in (F.floor, F.ceil))
        named[name] = low + (place - F.floor(place)) * (high - low)
    return out.select(*[rounded(named.get(n, F.col(n)), places).alias(n) for n in ("min", "p01", "p05", "mean", "median", "p95", "p99", "max")])


def key_values(row: DataFrame) -> DataFrame:
    """A one-row summary as (key, value) text."""
    items = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.explode(items).alias("kv")).select("kv.key", "kv.value")


def weighted_means(df: DataFrame, weight: str, *columns: str) -> DataFrame:
    """Averages weighted by frames; a total weight below one counts as one."""
    total = F.greatest(F.sum(weight), F.lit(1).cast("double"))
    return df.agg(*[rounded(F.sum(F.col(c) * F.col(weight)) / total).alias(c) for c in columns])


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their place in sorted order, from 0."""
    return ranked(df.select(column).distinct(), column, name="index").withColumn("index", F.col("index") - 1)

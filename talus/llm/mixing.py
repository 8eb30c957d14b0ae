"""Mixing of sources to target weights: hash-random order, range sorts, distributed prefix sums, and exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, broadcast_if_small
from talus.llm.line_dedup import ordered_ranks

BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words between white space; each word and what follows it shrinks to one letter, so no array is made."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], values: list[str], scratch: Scratch, name: str, about: DataFrame | None = None, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``rows`` with ``before_<value>``, the sum of each value over the rows before in the order within their group.

    Rows are sorted by ranges of (group, order), so a large group spreads over many ranges. Sums inside a range are a
    window; sums of whole ranges are carried over from range to range. ``about`` may hold further columns of each group;
    they reach the rows through the table of ranges, so no group's rows meet its row in one task. Group columns are not null.
    """
    ranged = scratch.save(rows.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), f"{name}-ranged")
    parts = scratch.save(ranged.groupBy("__range", *group).agg(*[F.sum(v).alias(v) for v in values]), f"{name}-parts")
    # one row for each range that a group has
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = parts.select("__range", *group, *[F.coalesce(F.sum(v).over(earlier), zero).alias(f"__carried_{v}") for v in values])
    if about is not None:
        carried = carried.join(broadcast_if_small(about, 48, broadcast_limit), group)
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"__inside_{v}") for v in values])
    found = placed.join(broadcast_if_small(carried, 64, broadcast_limit), ["__range", *group])
    sums = {f"before_{v}": F.col(f"__carried_{v}") + F.col(f"__inside_{v}") for v in values}
    return found.withColumns(sums).drop("__range", *[f"__{k}_{v}" for v in values for k in ("carried", "inside")])


def source_targets(sizes: DataFrame, weights: Sequence[float], epochs: int, scratch: Scratch, share: float = 1.0) -> DataFrame:
    """no_source, src, source_size, weight, target: words that each source is to give.

    ``sizes`` has no_source, src and source_size. Sources in order of code points, a null one last, weigh ``weights`` in turn
    and share ``share`` of all words. A target stops at ``epochs`` times its source's size and what is over is shared anew by
    weight, until none is above. That is: target = min(limit, level * weight) with the one level that uses up the total. With
    sources in order of limit / weight, the level is found at the first source that it leaves below its limit, from sums over
    the sources before it.
    """
    ranks = ordered_ranks(sizes.select("no_source", "src"), ["no_source", "src"], scratch, "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.join(ranks, ["no_source", "src"]).withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int"))).drop("rank")
    rows = rows.withColumn("limit", F.col("source_size") * epochs).withColumn("ratio", F.try_divide("limit", "weight"))
    rows = scratch.save(rows.filter("weight > 0"), "weighted")
    whole = rows.agg(F.sum("weight").alias("weight")).first()
    total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    sums = prefix_sums(rows, [], ["ratio", "no_source", "src"], ["limit", "weight"], scratch, "level")
    level = (F.lit(total) - F.col("before_limit")) / (F.lit(whole["weight"] or 1.0) - F.col("before_weight"))
    below = sums.select(level.alias("level"), "ratio", "no_source", "src").filter("level <= ratio")
    first = below.agg(F.min_by("level", F.struct("ratio", "no_source", "src")).alias("level")).first()["level"]
    # where the shares pass all limits, every source gives all it may
    target = F.col("limit").cast("double") if first is None else F.least(F.col("limit").cast("double"), F.lit(first) * F.col("weight"))
    found = rows.select("no_source", "src", "source_size", "weight", target.alias("target"))
    return found if min(weights) > 0 else found.unionByName(sizes.join(rows, ["no_source", "src"], "left_anti").select("no_source", "src", "source_size", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target")))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (1, 2, 3),
    epochs: int = 3,
    share: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, weight, target, budget, repeats, place, taken.

    ``size`` counts words. A source's budget is its target to the nearest word. It gives all its documents as often as the
    budget holds its size (``repeats``), and once more those that come first in hash order, up to the budget to the word: the
    document at the cut gives its first words only. ``place`` is the number of words before a document in that order. The
    order is by a digest of ``seed`` and the id, so runs agree, on any number of executors; for another mix, take another seed.

    Defined cases: a null or empty text has size 0 and gives nothing. A null source is one of its own, after all others and
    apart from an empty one. Rows of equal ids follow one another, shorter ones first; rows without an id are ordered by
    their texts. Documents of a source of weight 0 give nothing. Very long texts are counted whole. Further columns of
    ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    ident = F.col(id_col).cast("string")
    key = F.unhex(F.md5(F.concat(F.lit(seed), F.lit("/"), F.coalesce(ident, F.md5(F.coalesce(F.col(text_col), F.lit("")))))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        word_count(F.coalesce(F.col(text_col), F.lit(""))).alias("size"), key.alias("key"),
    )
    rows = scratch.save(rows, "rows")
    sizes = scratch.save(rows.groupBy("no_source", "src").agg(F.sum("size").alias("source_size")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, epochs, scratch, share), "targets")

    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * epochs)
    repeats = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    targets = targets.withColumn("budget", budget).withColumn("repeats", repeats.cast("long")).withColumn("rest", F.col("budget") - F.col("repeats") * F.col("source_size"))
    placed = prefix_sums(rows, ["no_source", "src"], ["key", "doc_id", "size"], ["size"], scratch, "order", targets, broadcast_limit)
    again = F.least(F.col("size"), F.greatest(F.col("rest") - F.col("before_size"), F.lit(0).cast("long")))
    scratch.drop("rows", "sources-ranged", "sources", "sizes", "weighted", "level-ranged", "level-parts")
    return placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("src")).alias("source"), "size", "source_size", "weight", "target", "budget", "repeats",
        F.col("before_size").alias("place"), (F.col("repeats") * F.col("size") + again).alias("taken"),
    )

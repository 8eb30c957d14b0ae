"""Leakage of training prompts into a test set, over several layers of text identity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.metrics import rounded
from talus.operators.summary import mean


#: Beginnings of passages that are looked up in a plan's own set.
LEADS = 4000


def long_layers(df: DataFrame, layers: dict[str, str], *keep: str) -> DataFrame:
    """One row per row and layer: the kept columns, ``layer`` and ``key``."""
    keys = F.array(*[F.struct(F.lit(name).alias("layer"), F.col(c).cast("string").alias("key")) for name, c in layers.items()])
    return df.select(*keep, F.explode(keys).alias("k")).select(*keep, "k.layer", "k.key")


def match(test: DataFrame, train: DataFrame, layers: dict[str, str], key: str = "utt_id", preview: int = 20) -> DataFrame:
    """Per test row and layer: seen, match_count, and the first matching training ids, joined by ``;``.

    All layers are matched in one join. Training ids per key are pre-aggregated to a count; for the preview only keys that
    the test set has are gathered. A blank key never matches.
    """
    ours = long_layers(test, layers, key).filter("coalesce(key, '') <> ''")
    wanted = ours.select("layer", "key").distinct()
    theirs = long_layers(train, layers, key).filter("coalesce(key, '') <> ''").join(wanted, ["layer", "key"], "left_semi")
    counts = theirs.groupBy("layer", "key").agg(F.count("*").alias("match_count"))
    # ranks are cut within each task before the shuffle, so a key of many rows brings few to one place
    place = F.dense_rank().over(Window.partitionBy("layer", "key").orderBy(key))
    heads = theirs.withColumn("__place", place).filter(F.col("__place") <= preview).groupBy("layer", "key").agg(F.array_sort(F.collect_set(key)).alias("ids"))
    counts = counts.join(heads, ["layer", "key"])
    found = ours.join(counts, ["layer", "key"], "left").select(key, "layer", "match_count", "ids")
    every = long_layers(test, layers, key).select(key, "layer")
    out = every.join(found, [key, "layer"], "left")
    n = F.coalesce("match_count", F.lit(0).cast("long"))
    return out.select(key, "layer", (n > 0).alias("seen"), n.alias("match_count"), F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ";"), F.lit("")).alias("matched_ids"))


def with_any_layer(matched: DataFrame, key: str = "utt_id") -> DataFrame:
    """Adds the layer ``any_layer``: seen in one of them."""
    any_layer = matched.groupBy(key).agg(F.lit("any_layer").alias("layer"), F.bool_or("seen").alias("seen"))
    return matched.select(key, "layer", "seen").unionByName(any_layer)


def summary(matched: DataFrame, key: str = "utt_id") -> DataFrame:
    """Seen and unseen rows per layer, any layer included."""
    return with_any_layer(matched, key).groupBy("layer").agg(
        F.count_if("seen").alias("seen_count"), F.count_if(~F.col("seen")).alias("unseen_count"), rounded(F.avg(F.col("seen").cast("int"))).alias("seen_rate")
    )


def seen_unseen_metrics(matched: DataFrame, scored: DataFrame, methods: list[str], key: str = "utt_id") -> DataFrame:
    """Means of each method's rate over seen and unseen rows per layer; empty subsets are listed."""
    rows = with_any_layer(matched, key).join(scored, key)
    found = rows.groupBy("layer", "seen").agg(F.count("*").alias("sample_count"), *[mean(f"{m}_cer").alias(f"{m}_cer") for m in methods], *[F.count_if(f"{m}_critical").alias(f"{m}_critical_count") for m in methods])
    frame = with_any_layer(matched, key).select("layer").distinct().crossJoin(matched.sparkSession.createDataFrame([(True,), (False,)], "seen boolean"))
    return frame.join(found, ["layer", "seen"], "left").na.fill(0, ["sample_count", *[f"{m}_critical_count" for m in methods]])


def overlap_audit(df: DataFrame, layers: dict[str, str], splits: tuple[str, ...] = ("train", "dev", "test"), split: str = "split") -> DataFrame:
    """Per layer, how many keys each two splits share. One aggregation to the splits of each key serves all pairs."""
    member = long_layers(df, layers, split).groupBy("layer", "key").agg(*[F.bool_or(F.col(split) == s).alias(f"in_{s}") for s in splits])
    return member.groupBy("layer").agg(*[F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"{a}_{b}_overlap") for a, b in combinations(splits, 2)])


def passage_containment(docs: DataFrame, passages: DataFrame, doc_key: str = "doc_id", passage_key: str = "item_id", head: int = 8) -> DataFrame:
    """Documents that contain a passage word for word, as (document, passage).

    A passage is looked up by a digest of its first ``head`` words, or of all where it has fewer; places of a document
    travel as digest and position alone, and only texts that have candidates are read again and compared. Where passages have
    at most ``LEADS`` different beginnings of up to three words, places that begin otherwise are left out before any
    digest. Passages without words are in no document.
    """
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != "")
    digest = lambda ws, at, n: F.xxhash64(F.array_join(F.slice(ws, at, n), " "))
    heads = passages.select(passage_key, words.alias("pw")).filter("size(pw) > 0").withColumn("k", F.least(F.size("pw"), F.lit(head)))
    heads = heads.select(passage_key, F.array_join("pw", " ").alias("passage"), F.size("pw").alias("n"), "k", digest("pw", F.lit(1), F.col("k")).alias("h"))
    lengths = [r["k"] for r in heads.select("k").distinct().orderBy("k").collect()] or [head]  # ``head`` numbers at most
    first = F.least("k", F.lit(3))
    leads = heads.select(first.alias("lead"), F.array_join(F.slice(F.split("passage", " "), 1, first), " ").alias("words")).distinct().limit(LEADS + 1).collect()
    begins = {lead: [r["words"] for r in leads if r["lead"] == lead] for lead in (1, 2, 3)} if len(leads) <= LEADS else {}
    cut = docs.select(doc_key, words.alias("dw"))
    none = F.array().cast("array<struct<k:int,at:int,h:bigint>>")

    def places(k: int) -> Column:
        start = F.sequence(F.lit(1), F.greatest(F.size("dw") - k + 1, F.lit(1)))
        if begins:
            start = F.filter(start, lambda i: F.array_join(F.slice("dw", i, F.lit(min(k, 3))), " ").isin(begins[min(k, 3)]))
        found = F.transform(start, lambda i: F.struct(F.lit(k).alias("k"), (i - 1).alias("at"), digest("dw", i, F.lit(k)).alias("h")))
        return F.when(F.size("dw") >= k, found).otherwise(none)

    spots = cut.select(doc_key, F.explode(F.flatten(F.array(*[places(k) for k in lengths]))).alias("s")).select(doc_key, "s.*")
    met = spots.join(heads, ["k", "h"]).select(doc_key, passage_key, "at", "n", "passage")
    texts = docs.select(doc_key, words.alias("dw"))
    same = met.join(texts, doc_key).filter(F.array_join(F.slice("dw", F.col("at") + 1, F.col("n")), " ") == F.col("passage"))
    return same.select(doc_key, passage_key).distinct()

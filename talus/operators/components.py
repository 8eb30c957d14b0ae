"""Groups of rows that are linked through shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.digests import ordered_digests, ordered_texts
from talus.operators.leakage import long_layers
from talus.operators.shared import Workspace, copied, salted

#: Edges of a node, or nodes of a component, that meet its label in one task.
HUB = 100_000


def label_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` of an undirected graph with edges (a, b); a component is named by its smallest node.

    Smallest labels spread along edges, and each round also follows the labels of labels. A round is a written table, so
    plans stay short and a lost executor costs one round; the tables of earlier rounds are deleted. The label of a hub, or of a
    large component, is sent to as many tasks as share its edges or nodes.
    """
    work, step, pairs = Workspace(edges.sparkSession), 0, edges.select("a", "b")
    both = work.save(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    dealt, hubs = salted(both, "b", HUB, "a", work, "hubs")
    both = work.save(dealt, "edges")
    work.drop("pairs")
    labels = work.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels-0")
    while True:
        told = both.join(copied(labels.withColumnRenamed("node", "b"), "b", hubs), ["b", "__salt"])
        heard = told.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        near = work.save(labels.join(heard, "node", "left").select("node", F.least("comp", "heard").alias("comp"), F.col("comp").alias("was")), "near")
        up = near.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
        dealt, large = salted(near, "comp", HUB, "node", work, "large")
        found = dealt.join(copied(up, "comp", large), ["comp", "__salt"], "left")
        new = work.save(found.select("node", F.least("comp", "higher").alias("comp"), "was"), f"labels-{step + 1}")
        work.drop("near", "large", f"labels-{step}")
        if new.filter("comp <> was").isEmpty():
            work.drop("edges", "hubs")
            return new.select("node", "comp")
        labels, step = new.select("node", "comp"), step + 1


def prompt_components(df: DataFrame, layers: dict[str, str], key: str = "utt_id") -> DataFrame:
    """``key`` and ``comp``, the smallest id among rows linked through equal keys of any layer. Blank keys are keys too.

    Rows meet at keys, not with one another: a key links its rows to the smallest of them.
    """
    keyed = long_layers(df, layers, key).withColumn("key", F.coalesce("key", F.lit("")))
    first = keyed.groupBy("layer", "key").agg(F.min(key).alias("b"))
    edges = keyed.join(first, ["layer", "key"]).select(F.col(key).alias("a"), "b").distinct()
    return label_components(edges).withColumnRenamed("node", key)


def component_variants(df: DataFrame, comps: DataFrame, layers: dict[str, str], key: str = "utt_id") -> DataFrame:
    """comp, layer_no, variant and digest: the distinct keys of each component in each layer; a blank is one."""
    names = list(layers)
    rows = long_layers(df.join(comps, key), layers, "comp").withColumn("variant", F.coalesce("key", F.lit("")))
    layer_no = F.array_position(F.array(*map(F.lit, names)), F.col("layer")).cast("int") - 1
    found = rows.select("comp", layer_no.alias("layer_no"), "variant").distinct()
    return found.withColumn("digest", F.substring(F.sha2("variant", 256), 1, 16))


def component_digests(df: DataFrame, comps: DataFrame, layers: dict[str, str], key: str = "utt_id") -> DataFrame:
    """Per component: prompt_id from the sorted variants of each layer, rows, variant counts, and sorted digests of the variants.

    Variants are sorted and folded by ``ordered_digests``, so a component of very many is never gathered. Its cell of
    digests is as long as they are; ``component_variants`` has a row for each.
    """
    names, work = list(layers), Workspace(df.sparkSession)
    variants = work.save(component_variants(df, comps, layers, key), "variants")
    headings = tuple(("\n" if i else "") + f"{n.upper()}=" for i, n in enumerate(names))
    ids = ordered_digests(variants, ["comp"], "variant", "variant", "||", "layer_no", headings)
    lists = ordered_texts(variants, ["comp", "layer_no"], "digest", "digest", ";")
    counts = variants.groupBy("comp").agg(*[F.count_if(F.col("layer_no") == i).alias(f"{n}_variants") for i, n in enumerate(names)])
    lists = lists.groupBy("comp").agg(*[F.max(F.when(F.col("layer_no") == i, F.col("text"))).alias(f"{n}_hashes") for i, n in enumerate(names)])
    sizes = df.join(comps, key).groupBy("comp").agg(F.count("*").alias("sample_count"))
    out = sizes.join(ids, "comp").join(counts, "comp").join(lists, "comp")
    return out.select("comp", F.substring("digest", 1, 16).alias("prompt_id"), "sample_count", *[f"{n}_variants" for n in names], *[f"{n}_hashes" for n in names])


def with_prompt_ids(df: DataFrame, comps: DataFrame, digests: DataFrame, key: str = "utt_id") -> DataFrame:
    """Rows with the prompt_id of their component."""
    return df.join(comps, key).join(digests.select("comp", "prompt_id"), "comp").drop("comp")

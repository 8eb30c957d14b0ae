"""Near-duplicate detection by b-bit MinHash.

Each distinct shingle set is one node. Bands of full minima propose candidates; of the minima only the low bits stay, packed
into bit planes, and bit counts of two such signatures estimate a similarity, corrected for chance agreement. What passes is
confirmed on the full sets, so every reported link is exact.

No bucket's pairs are all emitted. First each node meets the centers of its buckets, the members with most company, and is
confirmed against the one that its signature is nearest to. Most buckets then lie in one component and need no more. What
is left are nodes in buckets of several components: these are joined by the rarest shingles of their sets. Two sets can
only be similar enough if they share a shingle of such a prefix, so no pair that shares a band is lost, and a shingle that
all copies have is in few prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, copied, releasing, salted, small_batches, with_null_safe
from talus.llm.components import HUB, connected_components

#: Minima a signature may have, and the probability with which bands may miss a pair at the threshold.
MINIMA, MISS = 360, 1e-6
#: Minima whose low bits are packed, and how many bits of each.
PACKED, BITS = 256, 2
#: A pair is confirmed on full sets if its estimate is within this many standard errors of the threshold.
ERRORS = 5.0
#: Pairs of a node that one task confirms; a node of more pairs is dealt out to several.
SPREAD = 1000


def band_shape(percent: int) -> tuple[int, int]:
    """Rows a band and bands: as many rows as ``MINIMA`` allow while a pair at the threshold is missed with ``MISS`` at most."""
    s = min(percent / 100, 1 - 1e-9)
    bands = {rows: math.ceil(math.log(MISS) / math.log1p(-(s**rows))) for rows in range(1, 17)}
    rows = max((r for r, b in bands.items() if r * b <= MINIMA), default=1)
    return rows, bands[rows]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text, A-Z lower-cased, split at ASCII white space.

    With fewer words than ``words``, the whole sequence is one shingle; without words there is none.
    """
    from xxhash import xxh64_intdigest

    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


class Signer:
    """Minima of multiply-add permutations of 32 bits, band keys and bit planes."""

    def __init__(self, rows: int, bands: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.rows, self.count = rows, bands
        size = max(rows * bands, PACKED)
        self.a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        self.room = np.empty((512, size), np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for s in range(0, len(high), len(self.room)):
            part = high[s : s + len(self.room), None]
            block = self.room[: len(part)]
            np.multiply(part, self.a, out=block)
            np.add(block, self.b, out=block)
            np.minimum(least, block.min(axis=0), out=least)
        return least

    def bands(self, minima: np.ndarray) -> np.ndarray:
        parts = minima[: self.rows * self.count].reshape(self.count, self.rows).astype(np.uint64)
        key = np.arange(self.count, dtype=np.uint64)
        for k in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        return key.view(np.int64)

    def planes(self, minima: np.ndarray) -> list[int]:
        """Bit by bit, ``PACKED`` / 64 longs each."""
        mixed = _mix(minima[:PACKED].astype(np.uint64))
        return [int(x) for k in range(BITS) for x in np.packbits((mixed >> np.uint64(k)).astype(np.uint8) & 1).view(np.int64)]


PLANES = [f"p{i}" for i in range(BITS * PACKED // 64)]


def estimate(left: str, right: str) -> Column:
    """Estimated similarity of two packed signatures: equal minima by bit counts, less those equal by chance."""
    per, agree = PACKED // 64, F.lit(0)
    for part in range(per):
        differ = F.lit(0).cast("long")
        for bit in range(BITS):
            name = PLANES[bit * per + part]
            differ = differ.bitwiseOR(F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}")))
        agree = agree + F.bit_count(F.bitwise_not(differ))
    chance = 0.5**BITS
    return (agree / PACKED - chance) / (1 - chance)


def _may_link(left: str, right: str, percent: int) -> Column:
    """Whether sizes and signatures of two nodes leave a link possible."""
    p = percent / 100 * (1 - 0.5**BITS) + 0.5**BITS
    least = percent / 100 - ERRORS * (p * (1 - p) / PACKED) ** 0.5 / (1 - 0.5**BITS)
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    return (100 * small >= percent * large) & (estimate(left, right) >= least)


def _digest(shingles: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(np.ascontiguousarray(shingles).tobytes())


def _sets(rows: DataFrame, wanted: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """nid and shingles of the nodes in ``wanted`` (nid, set_hash, first_doc), each from one of its texts, stored once."""
    ids = wanted.select(F.col("first_doc").alias("id")).distinct()
    if wanted.count() * 16 <= BROADCAST_LIMIT:
        ids = F.broadcast(ids)
    texts = with_null_safe(rows, ids, ["id"], "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_hashes(t or "", words).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"set_hash": [_digest(s) for s in found], "shingles": found})

    with small_batches(scratch.spark):
        shingled = texts.mapInPandas(releasing(sets), "set_hash binary, shingles array<long>")
        return scratch.save(shingled.join(wanted, "set_hash").select("nid", "shingles").dropDuplicates(["nid"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) whose full sets are similar. A node of many pairs sends its set to several tasks that share them."""
    inter = F.size(F.array_intersect("s", "t")).cast("long")

    def with_set(rows: DataFrame, key: str, name: str) -> DataFrame:
        dealt, many = salted(rows, key, SPREAD, ["a", "b"], scratch, f"many-{key}")
        return dealt.join(copied(sets.select(F.col("nid").alias(key), F.col("shingles").alias(name)), key, many), [key, "__salt"]).drop("__salt")

    both = with_set(with_set(scratch.save(pairs, "to-confirm"), "b", "t"), "a", "s")
    return (
        both.select("a", "b", inter.alias("inter"), (F.size("s") + F.size("t")).alias("both"))
        .filter(100 * F.col("inter") >= percent * (F.col("both") - F.col("inter")))
        .select("a", "b")
    )


def _across(shared: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """Pairs (a, b) of different components to confirm, of all that share a bucket; None if every bucket is one component.

    The nodes of mixed buckets are joined by prefixes of their sets, rarest shingles first: of n shingles, two similar sets
    share one among the first n - o + 1 of each, where o is the least overlap that a link needs. A shingle of one node
    alone takes its place in the prefix but joins nothing. Where a shingle's nodes are mostly of one component, these are
    not compared with each other. Before a pair is emitted, its sizes, the places of the shared shingle and the signatures
    must leave a link possible.
    """
    found = shared.select("key", "nid").join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    found = scratch.save(found, "placed")
    mixed = found.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    nodes = found.join(mixed, "key").select("nid", "comp").distinct()
    nodes = scratch.save(nodes.join(shared.groupBy("nid").agg(F.first("x").alias("x")), "nid"), "open")
    if nodes.isEmpty():
        return None
    tokens = sets.join(nodes.select("nid"), "nid").select("nid", F.explode("shingles").alias("token"))
    tokens = scratch.save(tokens, "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    # a node's shingles that others have too, rarest first
    common = tokens.join(often, "token").groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ranked"))
    n = F.col("x.n")
    prefix = common.join(nodes, "nid").select(
        "nid", "comp", "x", F.transform("ranked", lambda r: r["token"]).alias("ranked"), (n - F.size("ranked")).alias("own"),
        (n - F.ceil(percent * n / 100) + 1).alias("long"), (n - F.ceil(2 * percent * n / (100 + percent)) + 1).alias("short"),
    )
    prefix = prefix.withColumn("taken", F.slice("ranked", 1, F.greatest(F.col("long") - F.col("own"), F.lit(0)).cast("int")))
    entries = prefix.select("nid", "comp", "x", "own", "short", F.posexplode("taken").alias("at", "token"))
    entries = entries.select("token", "comp", "x", (F.col("own") + F.col("at")).alias("at"), (F.col("own") + F.col("at") < F.col("short")).alias("brief"))
    entries = scratch.save(entries, "entries")

    # of each shingle's nodes, those outside its largest component ask; a shingle within one component asks nothing
    largest = entries.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.count("*").alias("comps"))
    apart = entries.join(largest.filter("comps > 1").select("token", "largest"), "token")
    apart = scratch.save(apart.select("token", "brief", F.struct("comp", "x", "at").alias("e"), (F.col("comp") != F.col("largest")).alias("asks")), "apart")

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("token", F.col("e").alias(name))

    rest = F.least(F.col("i.x.n") - F.col("i.at"), F.col("j.x.n") - F.col("j.at"))  # all that the sets can share from here on
    in_order = F.struct("i.x.n", "i.x.nid") < F.struct("j.x.n", "j.x.nid")
    possible = (F.col("i.comp") != F.col("j.comp")) & in_order & (rest * (100 + percent) >= percent * (F.col("i.x.n") + F.col("j.x.n"))) & _may_link("i.x", "j.x", percent)
    brief, asks = apart.filter("brief"), apart.filter("asks")
    met = [side("i", brief.filter("asks")).join(side("j", apart), "token"), side("i", brief.filter("NOT asks")).join(side("j", asks), "token")]
    pairs = [m.filter(possible).select(F.col("i.x.nid").alias("a"), F.col("j.x.nid").alias("b")) for m in met]
    pairs = scratch.save(pairs[0].unionByName(pairs[1]).distinct(), "pairs")
    scratch.drop("placed", "open", "tokens", "entries", "apart")
    return pairs


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and ``key_col`` as text where it is given.

    Two texts are linked if the distinct ``words``-word shingles they share are at least ``percent`` in 100 of those
    either has. ``component_id`` is the smallest id reachable over links; the row that has it stays.

    Defined cases: a null text counts as empty; texts without words are linked with nothing and stay. Texts with equal
    shingle sets are one node, however many rows have them. Sets are held and compared as 64-bit hashes of their shingles. Rows that share an id and a text share a verdict. A null id
    yields to any other; a component of null ids only has a null component_id and keeps its rows. Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = band_shape(percent)
    keys = [key_col] if key_col else []

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(*shape)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                shingles = shingle_hashes(text or "", words)
                if len(shingles):
                    minima = signer.minima(shingles)
                    out.append((doc_id, len(shingles), _digest(shingles), signer.bands(minima), *signer.planes(minima)))
                else:
                    out.append((doc_id, 0, None, None, *[0] * len(PLANES)))
            yield pd.DataFrame(out, columns=["id", "n_shingles", "set_hash", "bands", *PLANES]).assign(**{c: batch[c].to_numpy() for c in keys})

    schema = "".join(f"`{c}` string, " for c in keys) + "id string, n_shingles long, set_hash binary, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES)
    with small_batches(spark):
        source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), *[F.col(c).cast("string").alias(c) for c in keys])
        signed = source.mapInPandas(releasing(sign), schema)
        signed = scratch.save(signed.withColumn("id", F.col("id").cast(id_type)), "signed")

    # one node for each distinct set; rows with equal sets have equal signatures, so any of them will do
    content = F.struct("n_shingles", "bands", *PLANES)
    nodes = (
        signed.filter("set_hash is not null")
        .groupBy("set_hash")
        .agg(F.min("id").alias("first_doc"), F.first(content).alias("s"))
        .select(F.monotonically_increasing_id().alias("nid"), "set_hash", "first_doc", "s.*")
    )
    nodes = scratch.save(nodes, "nodes")
    members = nodes.select("nid", F.explode("bands").alias("key")).repartition("key")  # one shuffle for both uses
    company = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    kept_keys = members.join(company, "key").groupBy("nid").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("weight"))
    node = F.struct("nid", F.col("n_shingles").alias("n"), *PLANES)
    shared = kept_keys.join(nodes.drop("bands"), "nid").select(F.explode("keys").alias("key"), "nid", "weight", node.alias("x"))
    shared = scratch.save(shared, "shared")  # rows of buckets with company, as many as bands for a node at most
    wanted = scratch.save(nodes.join(shared.select("nid").distinct(), "nid", "left_semi").select("nid", "set_hash", "first_doc"), "wanted")
    sets = _sets(rows, wanted, words, scratch)

    centers = shared.groupBy("key").agg(F.max_by("x", F.struct("weight", -F.col("nid"))).alias("c"))
    near = shared.join(centers, "key").filter((F.col("c.nid") != F.col("nid")) & _may_link("c", "x", percent))
    stars = near.groupBy(F.col("nid").alias("b")).agg(F.max_by("c.nid", F.struct(estimate("c", "x"), -F.col("c.nid"))).alias("a"))
    links = scratch.save(_confirmed(stars, sets, percent, scratch), "links-1")
    comps = connected_components(links, scratch, "cc-1")
    more = _across(shared, comps.withColumnRenamed("node", "nid"), sets, scratch, percent)
    if more is not None:
        further = scratch.save(_confirmed(more, sets, percent, scratch), "links-2")
        if not further.isEmpty():
            comps = connected_components(links.unionByName(further), scratch, "cc-2")

    labelled = nodes.select("nid", "set_hash", "first_doc").join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    labelled = scratch.save(labelled.withColumn("comp", F.coalesce("comp", "nid")), "final")
    first = labelled.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    dealt, large = salted(labelled, "comp", HUB, ["nid"], scratch, "large")
    named = dealt.join(copied(first, "comp", large), ["comp", "__salt"]).select("set_hash", "component_id")
    scratch.drop("shared", "wanted", "sets", "links-1", "links-2", "pairs", "to-confirm", "many-a", "many-b")
    dealt, common = salted(signed.select("id", "n_shingles", "set_hash", *keys), "set_hash", HUB, ["id"], scratch, "common")  # copies of one set
    joined = dealt.join(copied(named, "set_hash", common), ["set_hash", "__salt"], "left")
    component = F.when(F.col("set_hash").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *keys
    )

"""Divergence of sources within a language, in exact integers: dense numpy tiles for common terms, sparse corrections for rare ones.

With p and q the probabilities of a term in two groups, in parts of 10^9, a pair's value sums f(p, q) = (p - q)^2 div q over all terms
of the language. Terms that many groups have ("heavy") are laid out as tiles, terms by groups, and every two columns are summed
over. For the others ("light"), most groups have count 0 and so one value, p0 or q0:

    sum of f(p, q) = V f(p0, q0) + over terms of one group: f(p, q0) - f(p0, q0)
                   + over terms of the other: f(p0, q) - f(p0, q0)
                   + over terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The single sums depend on a term's count alone and come from each group's histogram of counts; the last one comes from the light
terms' postings. All partial sums are integers and added exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, broadcast_if_small, small_batches

SCALE = 1_000_000_000
#: Groups in a block of a tile, terms in a heavy tile, and postings in a tile of light terms.
BLOCK, TERMS, POSTINGS = 256, 1024, 200_000
#: A term is light if so many groups have it at most, or so small a part of its language's groups.
LIGHT_GROUPS, LIGHT_PART = 4, 16

PAIRS = "lang string, p_group long, q_group long, value decimal(38,0)"

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of non-ASCII characters, A-Z lower-cased; every byte of a non-ASCII character belongs to a term."""
    return text.translate(_KEEP).split()


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, limit: int = 200_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); and a row with a null term for each group.

    Tasks add up what they have read and send it on once it has ``limit`` entries.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, having) in seen.items():
                terms = pa.array([None, *n], pa.binary()).cast(pa.string())
                group = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))) for x in (lang, source)]
                counts = [pa.array([0, *c], pa.int64()) for c in (n.values(), (having[t] for t in n))]
                yield pa.RecordBatch.from_arrays([*group, terms, *counts], names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, having = seen.setdefault((lang, source), (Counter(), Counter()))
                terms = terms_of(text.encode())
                n.update(terms)
                having.update(set(terms))
            if sum(len(n) + 1 for n, _ in seen.values()) >= limit:
                yield from flush()
        yield from flush()

    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    given = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    found = given.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), by decimals, as the product may pass 64 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", scaled, total.cast("decimal(19,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Audit:
    """Kept terms' postings and the groups' sizes, as tables, and what is computed from them."""

    def __init__(self, docs: DataFrame, *, min_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT):
        self.scratch, self.limit = Scratch(docs.sparkSession, "divergence"), broadcast_limit
        with small_batches(docs.sparkSession):
            counts = self.scratch.save(term_counts(docs, lang_col, source_col, text_col), "counts")
        same = Window.partitionBy("lang", "term")  # a row for each source that has the term
        found = counts.filter("term IS NOT NULL").select(
            "*", F.sum("docs").over(same).alias("lang_docs"), F.sum("n").over(same).alias("lang_n"), F.count("*").over(same).alias("n_groups"), (F.row_number().over(same.orderBy("source")) == 1).alias("first")
        )
        kept = self.scratch.save(found.filter(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"), "kept")
        zero = F.lit(0).cast("long")
        langs = kept.filter("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        names = counts.filter("term IS NULL").select("lang", "source")
        members = Window.partitionBy("lang")  # a row a source
        groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select(
            "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")],
            (F.row_number().over(members.orderBy("source")) - 1).cast("long").alias("gid"), F.count("*").over(members).alias("n_sources"),
        )
        p0 = F.when(F.col("v") > 0, probability(zero, F.col("total") + F.col("v"))).otherwise(zero)
        self.groups = self.scratch.save(groups.withColumn("p0", p0), "groups")
        sized = kept.join(broadcast_if_small(self.groups, 64, broadcast_limit), ["lang", "source"])
        heavy = F.col("n_groups") > F.greatest(F.lit(LIGHT_GROUPS), F.col("n_sources") / LIGHT_PART)
        postings = sized.select(
            "lang", "source", "gid", "term", "n", "p0", heavy.alias("heavy"), probability(F.col("n"), F.col("total") + F.col("v")).alias("p"),
            probability(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("lang_p"), "n_sources", "first",
        )
        self.postings = self.scratch.save(postings, "postings")
        self.scratch.drop("counts", "kept")

    def _tiled(self, rows: DataFrame, in_tile: int, unit: str) -> DataFrame:
        """Rows with ``tile``, a number below n_tiles by the term's digest, so that a language's tile has about so many units."""
        sizes = rows.groupBy("lang").agg(F.expr(f"1 + {unit} div {in_tile}").alias("n_tiles"))
        return rows.join(broadcast_if_small(sizes, 32, self.limit), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), "n_tiles"))

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Rows once for each two blocks of groups that theirs takes part in; ``side`` 1 is the pair's first, 2 its second, 3 both."""
        last = F.expr(f"(n_sources - 1) div {BLOCK}")
        own = F.expr(f"gid div {BLOCK}")
        each = F.explode(F.sequence(F.lit(0).cast("long"), last))
        first = rows.select("*", own.alias("pb"), each.alias("qb")).withColumn("side", F.when(F.col("pb") == F.col("qb"), 3).otherwise(1))
        second = rows.select("*", each.alias("pb"), own.alias("qb")).filter("pb <> qb").withColumn("side", F.lit(2))
        return first.unionByName(second)

    def heavy_sums(self) -> DataFrame:
        """Sums over heavy terms, by tiles of ``TERMS`` terms and two blocks of groups."""
        heavy = self._tiled(self.postings.filter("heavy"), TERMS, "count_if(first)")
        tiles = self.scratch.save(heavy.select("lang", "tile", "gid", "term", "p", "n_sources"), "heavy")
        n_terms = self.scratch.save(tiles.groupBy("lang", "tile").agg(F.count_distinct("term").alias("n_terms")), "n_terms")
        own = self.groups.select("lang", "gid", "p0", "n_sources").join(broadcast_if_small(n_terms, 48, self.limit), "lang")
        left = self._blocks(tiles).select("lang", "tile", "pb", "qb", "side", "gid", "term", "p")
        right = self._blocks(own).select("lang", "tile", "pb", "qb", "side", "gid", "p0", "n_terms")

        def add(rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
            n, number = int(groups["n_terms"].iloc[0]), pd.factorize(rows["term"])[0]
            sides = []
            for side in (1, 2):
                g = groups[groups["side"].to_numpy(np.int64) & side > 0].sort_values("gid")
                ids = g["gid"].to_numpy(np.int64)
                tile = np.repeat(g["p0"].to_numpy(np.int64)[:, None], n, axis=1)
                mine = rows["side"].to_numpy(np.int64) & side > 0
                tile[np.searchsorted(ids, rows["gid"].to_numpy(np.int64)[mine]), number[mine]] = rows["p"].to_numpy(np.int64)[mine]
                sides.append((ids, tile))
            (ps, p), (qs, q) = sides
            sums = np.array([_f(one, q).sum(axis=1) for one in p])
            return _pairs(groups["lang"].iloc[0], ps, qs, sums)  # two blocks may have no posting of the tile

        keys = ["lang", "tile", "pb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(add, PAIRS)

    def light_singles(self) -> DataFrame:
        """For each pair V f(p0, q0) over the language's light terms, and what terms of either group add to it."""
        light = self.postings.filter("NOT heavy")
        n_light = light.filter("first").groupBy("lang").agg(F.count("*").alias("n_light"))
        counted = light.groupBy("lang", "gid", "p", "n_sources").agg(F.count("*").alias("times"))
        base = self.groups.join(broadcast_if_small(n_light, 32, self.limit), "lang").select("lang", "gid", F.lit(None).cast("long").alias("p"), "n_sources", F.col("n_light").alias("times"), "p0")
        rows = counted.join(broadcast_if_small(self.groups.select("lang", "gid", "p0"), 40, self.limit), ["lang", "gid"]).select(base.columns).unionByName(base)

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            base = rows[rows["p"].isna()].sort_values("gid")
            ids, p0 = base["gid"].to_numpy(np.int64), base["p0"].to_numpy(np.int64)
            ours, theirs = (base["side"].to_numpy() & side > 0 for side in (1, 2))
            qs, q0 = ids[theirs], p0[theirs]
            ps, sums = ids[ours], int(base["times"].iloc[0]) * _f(p0[ours][:, None], q0)
            found = rows[rows["p"].notna()]
            for side, known, others in ((1, ps, q0), (2, qs, p0[ours])):
                part = found[found["side"].to_numpy() & side > 0]
                at = np.searchsorted(known, part["gid"].to_numpy(np.int64))
                for i, p, own, times in zip(at, part["p"].astype("int64"), part["p0"], part["times"], strict=True):
                    if side == 1:
                        sums[i] += times * (_f(p, others) - _f(own, others))
                    else:
                        sums[:, i] += times * (_f(others, p) - _f(others, own))
            return _pairs(rows["lang"].iloc[0], ps, qs, sums)

        return self._blocks(rows).groupBy("lang", "pb", "qb").applyInPandas(add, PAIRS)

    def light_pairs(self) -> DataFrame:
        """Corrections for light terms that both groups have, from tiles of postings; a tile's sums are added before they leave it."""
        light = self._tiled(self.postings.filter("NOT heavy"), POSTINGS, "count(*)")

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            term = pd.factorize(rows["term"])[0]
            order = np.argsort(term, kind="stable")
            term, gid, p, p0 = term[order], *(rows[c].to_numpy(np.int64)[order] for c in ("gid", "p", "p0"))
            sums: Counter[tuple[int, int]] = Counter()
            for step in range(1, len(term)):  # as many as a light term has groups
                a = np.nonzero(term[step:] == term[:-step])[0]
                if not len(a):
                    break
                for i, j in ((a, a + step), (a + step, a)):
                    value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
                    pairs, at = np.unique(np.stack([gid[i], gid[j]]), axis=1, return_inverse=True)
                    added = np.zeros(pairs.shape[1], np.int64)
                    np.add.at(added, at.ravel(), value)
                    for x, y, v in zip(*pairs.tolist(), added.tolist(), strict=True):
                        sums[x, y] += v
            return pd.DataFrame([(rows["lang"].iloc[0], x, y, Decimal(int(v))) for (x, y), v in sums.items()], columns=["lang", "p_group", "q_group", "value"])

        return light.select("lang", "tile", "gid", "term", "p", "p0").groupBy("lang", "tile").applyInPandas(add, PAIRS)

    def pairs(self) -> DataFrame:
        """lang, source, item, value for every two sources of a language."""
        sums = self.heavy_sums().unionByName(self.light_singles()).unionByName(self.light_pairs())
        sums = self.scratch.save(sums.groupBy("lang", "p_group", "q_group").agg(F.sum("value").alias("value")), "pairs")
        named = broadcast_if_small(self.groups.select("lang", "gid", "source"), 48, self.limit)
        # pairs of a language without kept terms have no sums
        ours = self.groups.select("lang", "source", F.col("gid").alias("p_group"), "n_sources", "v")
        empty = ours.filter("v = 0").withColumn("q_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sources") - 1)))
        found = sums.join(broadcast_if_small(ours.select("lang", "source", "p_group"), 48, self.limit), ["lang", "p_group"]).unionByName(
            empty.select("lang", "p_group", "q_group", F.lit(0).cast("decimal(38,0)").alias("value"), "source")
        )
        both = found.filter("p_group <> q_group").join(named.select("lang", F.col("gid").alias("q_group"), F.col("source").alias("item")), ["lang", "q_group"])
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # a row a source
        return both.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"), place.alias("rank"))

    def top_terms(self, most: int = 200) -> DataFrame:
        """lang, source, item, value: the terms that a group has more of than its language, those that say most first."""
        more = self.postings.filter("p > lang_p").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("lang_p")).alias("value"))
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # cut to ``most`` before the shuffle too
        return more.withColumn("rank", place).filter(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(lang: str, ps: np.ndarray, qs: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "p_group": np.repeat(ps, len(qs)), "q_group": np.tile(qs, len(ps)), "value": [Decimal(int(v)) for v in sums.ravel()]})


def source_divergence(docs: DataFrame, *, top: int = 200, **options) -> DataFrame:
    """One row per group and item: lang, source, part (``pair`` or ``term``), item, value, rank.

    A group is a (lang, source) that occurs. A language keeps the terms that at least ``min_docs`` of its documents have. Part
    ``pair`` has, for every other source of the language, the divergence of the group from it over all kept terms; part ``term`` has
    the group's ``top`` terms by divergence from the language. Ranks start at 1, larger values first, ties by the item's bytes.

    Defined cases: null texts, languages and sources count as empty ones. A group without terms has the probability of count 0
    for all; where a language keeps no term, its pairs have value 0. Repeated rows are documents of their own. Very long texts are
    counted whole. Further columns are ignored. An empty table gives an empty result. Sums fit 64 bits while a language
    keeps fewer than 10^9 terms; beyond that the cast fails rather than wraps.
    """
    audit = Audit(docs, **options)
    return audit.pairs().unionByName(audit.top_terms(top))

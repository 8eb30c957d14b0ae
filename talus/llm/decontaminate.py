"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index holds the postings (term, document, position) of all words of the training texts that the benchmark has too; a
text is tokenised once, for the index. A window's phrase can only occur where the postings of its two rarest terms, each
moved back by its place in the item, meet. At such a shift the lists of all the item's terms, moved back alike, are intersected,
and every run of places that are all there, as long as a window, is an occurrence. Proximity matches take the same lists, within bins of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, ascii_lower, broadcast_if_small

#: What separates words: ASCII characters other than digits and lower-case letters, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A term that no text has; its posting stands after a text's last word.
END = ""


def words_of(text: Column) -> Column:
    """Words of a text; of a null or blank text, no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


class BenchmarkIndex:
    """Postings of the training texts, stored as a table, and the benchmark items searched in them."""

    def __init__(
        self, docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
        item_col: str = "item_id", item_text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT,
    ):
        self.scratch = scratch = Scratch(docs.sparkSession, "index")
        self.limit = broadcast_limit
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        # rows need a key of their own, as ids may repeat or be null: the text's digest stands for what is searched
        self.rows = rows.withColumn("doc_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))

        items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text_col)).alias("words")).filter(F.size("words") > 0)
        items = items.distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("width"))
        self.items = scratch.save(items, "items")
        self.places = scratch.save(self.items.select("item", F.posexplode("words").alias("place", "term")), "places")
        terms = self.places.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(END,)], "term string"))
        self.terms = scratch.save(terms.withColumn("t", F.monotonically_increasing_id()), "terms")
        self.places = scratch.save(self.places.join(self._small(self.terms, 24), "term").select("item", "place", "t"), "placed")

        # all training texts are cut into words here, once
        tokens = self.rows.select("doc_id", "doc_key", F.posexplode(F.array_append(words_of(F.col("text")), F.lit(END))).alias("pos", "term"))
        index = tokens.join(self._small(self.terms, 24), "term").select("t", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"), "doc_key", "pos")
        index = scratch.save(index, "index")
        end = self.terms.filter(F.col("term") == END).first()["t"]
        self.documents = index.filter(F.col("t") == end).select("doc_id", "doc_key", F.col("pos").cast("long").alias("n_words"))
        self.postings = index.filter(F.col("t") != end).select("t", "doc_key", "pos")
        self.frequency = scratch.save(self.postings.groupBy("t").agg(F.count("*").alias("frequency")), "frequency")

        # windows start at each place that leaves room for one; a shorter item is one window
        widths = self.items.select("item", "width", (F.size("words") - F.col("width")).alias("last"))
        starts = F.sequence(F.greatest(F.col("place") - F.col("width") + 1, F.lit(0)), F.least("place", "last"))
        held = self.places.join(self._small(widths, 24), "item").select("item", "place", "t", F.explode(starts).alias("start"))
        self.windows = held.select("item", "start", (F.col("place") - F.col("start")).alias("at"), "t")
        ranked = (
            self.windows.join(self.frequency, "t", "left")
            .withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("long")))
            .groupBy("item", "start")
            .agg(F.array_sort(F.collect_list(F.struct("frequency", "at", "t"))).alias("ranked"))
        )
        # a window with a term that never occurs cannot be met
        self.live = ranked.filter(F.col("ranked")[0]["frequency"] > 0)
        self.chosen = scratch.save(self.live.select("item", "start", F.slice("ranked", 1, 2).alias("chosen")), "chosen")

    def _small(self, df: DataFrame, row_bytes: int) -> DataFrame:
        return broadcast_if_small(df, row_bytes, self.limit)

    def _lists(self, keys: DataFrame) -> DataFrame:
        """t, doc_key and pos: the postings of each text whose key is given; equal texts once."""
        return self.postings.join(self._small(keys.distinct(), 16), "doc_key", "left_semi").distinct()

    def alignments(self) -> DataFrame:
        """item, doc_key, shift: where the rarest terms of a window both stand at their distance. One list meets the other by equal shifts."""
        first, last = F.col("chosen")[0], F.element_at("chosen", -1)
        pairs = self.chosen.select("item", (F.col("start") + first["at"]).alias("a"), (F.col("start") + last["at"]).alias("b"), first["t"].alias("ta"), last["t"].alias("tb")).distinct()
        roles = F.array(F.struct(F.col("ta").alias("t"), F.col("a").alias("place"), F.lit(1).alias("role")), F.struct(F.col("tb").alias("t"), F.col("b").alias("place"), F.lit(2).alias("role")))
        roles = self.scratch.save(pairs.select("item", "a", "b", F.explode(roles).alias("r")).select("item", "a", "b", "r.*"), "roles")
        lists = self.postings.join(self._small(roles, 48), "t").select("item", "a", "b", "doc_key", (F.col("pos") - F.col("place")).alias("shift"), "role")
        met = lists.groupBy("item", "a", "b", "doc_key", "shift").agg(F.bit_or("role").alias("roles")).filter("roles = 3")
        return self.scratch.save(met.select("item", "doc_key", "shift").distinct(), "met")

    def runs(self) -> DataFrame:
        """item, doc_key, shift, place, length: maximal runs of words that item and text share, as long as a window at least."""
        met = self.alignments()
        wanted = met.join(self._small(self.places, 24), "item").select("item", "doc_key", "shift", "place", "t", (F.col("place") + F.col("shift")).alias("pos"))
        equal = wanted.join(self._lists(met.select("doc_key")), ["doc_key", "pos", "t"]).select("item", "doc_key", "shift", "place")
        along = Window.partitionBy("item", "doc_key", "shift").orderBy("place")  # an item's places at most
        islands = equal.withColumn("island", F.col("place") - F.row_number().over(along))
        found = islands.groupBy("item", "doc_key", "shift", "island").agg(F.min("place").alias("place"), F.count("*").alias("length"))
        widths = self._small(self.items.select("item", "width"), 16)
        return self.scratch.save(found.join(widths, "item").filter("length >= width").select("item", "doc_key", "shift", "place", "length", "width"), "runs")

    def phrase_matches(self) -> DataFrame:
        """item, start, doc_key, pos, length: every occurrence of every window, exact."""
        starts = F.sequence(F.col("place"), (F.col("place") + F.col("length") - F.col("width")).cast("int"))
        each = self.runs().select("item", "doc_key", "shift", F.explode(starts).alias("start"), F.col("width").cast("long").alias("length"))
        return each.select("item", "start", "doc_key", (F.col("start") + F.col("shift")).alias("pos"), "length")

    def proximity_matches(self, slop: int = 20) -> DataFrame:
        """item, start, doc_key, first, last: windows all of whose words occur within ``slop`` words of a text, in any order.

        The lists of a window's two rarest terms propose places: those of the rarest that have the other near. Around each place
        the lists of all terms are read once, and the windows of that pair are looked for there. Windows that share a pair
        share its places; a place has fewer than twice ``slop`` words around it, so nothing grows with the frequent terms.
        """
        terms = self.live.select("item", "start", F.array_distinct("ranked.t").alias("terms"))
        sets = self.scratch.save(terms.withColumns({"ta": F.col("terms")[0], "tb": F.col("terms")[F.least(F.lit(1), F.size("terms") - 1)]}), "sets")
        pairs = self.scratch.save(sets.select("ta", "tb").distinct(), "pairs")
        spots = self.postings.withColumn("bin", F.floor(F.col("pos") / slop))
        near = F.abs(F.col("pos") - F.col("at")) < slop

        rarest = self.postings.withColumnsRenamed({"t": "ta", "pos": "at"}).join(self._small(pairs, 16), "ta").select("ta", "tb", "doc_key", "at").distinct()
        rarest = self._binned(self.scratch.save(rarest, "rarest"), slop)
        met = spots.withColumnRenamed("t", "tb").join(self._small(pairs, 16), "tb").join(self._small(rarest, 40), ["ta", "tb", "doc_key", "bin"])
        met = self.scratch.save(met.filter(near).select("ta", "tb", "doc_key", "at").distinct(), "near")

        places = met.select("doc_key", "at").distinct()
        known = spots.join(self._small(places.select("doc_key").distinct(), 16), "doc_key", "left_semi")
        around = known.join(self._small(self._binned(places, slop), 24), ["doc_key", "bin"]).filter(near)
        around = around.groupBy("doc_key", "at").agg(F.array_sort(F.collect_set(F.struct("pos", "t"))).alias("around"))

        # a window's spans that hold the place: all their words are around it
        wanted = met.join(self._small(sets, 32), ["ta", "tb"]).join(around, ["doc_key", "at"])
        wanted = wanted.withColumn("spots", F.filter("around", lambda s: F.array_contains("terms", s["t"])))
        inside = lambda s: F.filter("spots", lambda t: (t["pos"] >= s["pos"]) & (t["pos"] < s["pos"] + slop))
        holding = F.filter("spots", lambda s: (s["pos"] <= F.col("at")) & (s["pos"] > F.col("at") - slop))
        full = F.filter(F.transform(holding, lambda s: F.struct(s["pos"].alias("first"), inside(s).alias("inside"))), lambda s: F.size(F.array_distinct(s["inside"]["t"])) == F.size("terms"))
        return (
            wanted.filter(F.size(F.array_distinct("spots.t")) == F.size("terms"))
            .select("item", "start", "doc_key", F.explode(full).alias("s"))
            .select("item", "start", "doc_key", F.col("s.first").alias("first"), F.array_max("s.inside.pos").alias("last"))
            .distinct()
        )

    def proximity_report(self, slop: int = 20) -> DataFrame:
        """doc_id, item_id, n_near (windows of the item whose words stand close together in the document) and first and last, the places that they span."""
        near = self.proximity_matches(slop).groupBy("item", "doc_key").agg(F.count_distinct("start").alias("n_near"), F.min("first").cast("long").alias("first"), F.max("last").cast("long").alias("last"))
        named = near.join(self._small(self.items.select("item", "item_id"), 16), "item")
        return self.documents.join(named, "doc_key").select("doc_id", "item_id", "n_near", "first", "last")

    def _binned(self, places: DataFrame, slop: int) -> DataFrame:
        """``places`` once for each bin of ``slop`` words that has words near ``at``."""
        bin_ = F.floor(F.col("at") / slop)
        return places.withColumn("bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))

    def report(self) -> DataFrame:
        """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
        begin = (F.col("place") + F.col("shift")).cast("long")
        spans = self.runs().select("item", "doc_key", begin.alias("lo"), (begin + F.col("length")).alias("hi"))
        # lengths of a union of spans, in order of their beginnings
        before = Window.partitionBy("doc_key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("past", F.coalesce(F.max("hi").over(before), F.lit(0).cast("long")))
        fresh = F.greatest(F.lit(0).cast("long"), F.col("hi") - F.greatest("lo", "past"))
        named = spans.join(self._small(self.items.select("item", "item_id"), 16), "item")
        per_key = named.groupBy("doc_key").agg(F.sum(fresh).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        out = self.documents.join(self._small(self.scratch.save(per_key, "hits"), 32), "doc_key", "left")
        ids = F.coalesce("item_ids", F.array().cast("array<string>"))
        n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
        return out.select(
            "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of a benchmark window; ``n_items`` counts items with such a window, and
    ``items_sha256`` is the digest of their ids, sorted as strings and comma-joined.

    Defined cases: null texts and items have no words; items without words are never found. An item without an id hits words
    but is not counted or named. Repeated rows each have the result of their text; repeated items count once by id. Null ids
    of documents stay null. Further columns are ignored; empty tables give an empty or a clean result.
    """
    return BenchmarkIndex(docs, benchmark, **options).report()

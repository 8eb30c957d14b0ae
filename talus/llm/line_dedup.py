"""Deletion of line runs that repeat, from a suffix array over sequences of line ids, in DataFrame operations only.

Lines that occur once cannot be part of a repeat; they split the sequences into stretches of others. A run counts as a
repeat from ``min_words`` words on, and a line has a word at least, so the runs of just enough words that begin or end
somewhere have ``min_words`` lines at most, and the longest of them tells how deep suffixes need to be sorted.

Prefix doubling ranks the suffixes by their first 2, 4, 8, ... lines: each round sorts the distinct pairs of ranks. Suffixes
equal to that depth are one entry of the array, however many there are, so a very common run is no hot key. Neighbours in
the array are compared to their longest common prefix. For each length that a run of just enough words has, the array falls
into intervals of entries that share so many lines; all of an interval but its first place in document order is a later
copy. Later copies that touch or overlap make up the maximal repeated runs, and these are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, broadcast_if_small, free_prefix, with_null_safe

BLANKS = " \t\r\x0b\x0c"


def content_lines(text: Column) -> Column:
    """Lines that are not blank, without white space at their ends."""
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS))), lambda line: line != "")


def ordered_ranks(keys: DataFrame, columns: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Distinct rows with ``rank``, their place in sorted order: ranges are sorted apart and numbered by offsets."""
    ranged = scratch.save(keys.repartitionByRange(*columns).withColumn("pid", F.spark_partition_id()), f"{name}-ranged")
    # one row a range, as many as shuffle partitions
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(*columns))
    return scratch.save(ranged.withColumn("nth", inside).join(F.broadcast(offsets), "pid").select(*columns, (F.col("offset") + F.col("nth")).alias("rank")), name)


def suffix_ranks(rows: DataFrame, longest: int, scratch: Scratch, broadcast_limit: int) -> DataFrame:
    """``rows`` with ``rank``, the place of each suffix in the array sorted by its first ``longest`` lines or more.

    Each round sorts the distinct pairs of a suffix's rank and that of the suffix as many lines further on as the ranks
    cover so far; 0, before all ranks, stands for the end of a stretch. Once a round tells no more suffixes apart, further
    ones would not either.
    """
    rows, k, covered, classes = rows.withColumn("rank", F.col("line")), 0, 1, -1
    while covered < longest:
        ahead = F.lead("rank", covered, 0).over(Window.partitionBy("text_key", "stretch").orderBy("pos"))
        paired = scratch.save(rows.withColumn("b", ahead).withColumnRenamed("rank", "a"), f"paired-{k}")
        ranks = ordered_ranks(paired.select("a", "b").distinct(), ["a", "b"], scratch, f"ranks-{k}")
        rows = scratch.save(paired.join(broadcast_if_small(ranks, 48, broadcast_limit), ["a", "b"]).drop("a", "b"), f"level-{k}")
        before, classes = classes, ranks.count()
        scratch.drop(f"paired-{k}", f"ranks-{k}-ranged", f"ranks-{k}", f"level-{k - 1}")
        k, covered = k + 1, 2 * covered
        if classes == before:
            break
    return rows


def common_prefixes(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes`` with ``lcp``: how many lines each has in common with the one before it in the array.

    Ranges of the array are compared apart; the first of a range meets the last of the range before.
    """
    ranged = scratch.save(classes.repartitionByRange("rank").withColumn("pid", F.spark_partition_id()), "array-ranged")
    lasts = ranged.groupBy("pid").agg(F.max_by("ids", "rank").alias("last"))  # one row a range
    lasts = lasts.select("pid", F.lag("last").over(Window.orderBy("pid")).alias("last"))
    inside = F.lag("ids").over(Window.partitionBy("pid").orderBy("rank"))
    pairs = ranged.withColumn("previous", inside).join(F.broadcast(lasts), "pid").withColumn("previous", F.coalesce("previous", "last", F.array().cast("array<bigint>")))
    equal = F.zip_with("previous", "ids", lambda x, y: x.eqNullSafe(y))
    differ = F.array_position(equal, False)
    return pairs.select(*classes.columns, F.when(differ == 0, F.size("ids").cast("long")).otherwise(differ - 1).alias("lcp"))


def prefix_intervals(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """rank, size and ``first``, the first place of the interval of suffixes whose first ``size`` lines are equal, if it has several.

    Suffixes with equal first lines of enough words have the same sizes, so in the array's order an interval for a size
    begins where fewer lines are common with the suffix before, and goes on to the next such place.
    """
    entries = common_prefixes(classes, scratch).select("rank", F.explode("sizes").alias("size"), "first", "n", "lcp")
    ranged = scratch.save(entries.repartitionByRange("size", "rank").withColumn("pid", F.spark_partition_id()), "entries-ranged")
    begins = F.when(F.col("lcp") < F.col("size"), F.struct("size", "rank"))
    upto = F.max(begins).over(Window.partitionBy("pid").orderBy("size", "rank").rowsBetween(Window.unboundedPreceding, 0))
    # one row a range
    carried = F.max("latest").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranged.groupBy("pid").agg(F.max(begins).alias("latest")).select("pid", carried.alias("carried"))
    found = ranged.withColumn("upto", upto).join(F.broadcast(ranges), "pid")
    found = scratch.save(found.select("rank", "size", "first", "n", F.coalesce("upto", "carried").alias("interval")), "entries")
    whole = found.groupBy("interval").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").select("interval", "first")
    return found.drop("first", "n").join(whole, "interval").select("rank", "size", "first")


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int, broadcast_limit: int) -> tuple[DataFrame, DataFrame]:
    """``runs``: text_key and spans (begin, end) of lines to delete; ``copies``: doc_id, text_key of texts seen before."""
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    ids = scratch.save(rows.select("doc_id", "text_key"), "ids")
    many = scratch.save(ids.distinct().groupBy("text_key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("text_key", "first"), "many")
    copies = ids.distinct().join(broadcast_if_small(many, 64, broadcast_limit), "text_key").filter(order != F.col("first")).select("doc_id", "text_key")
    copies = scratch.save(copies, "copies")

    # one document for each text, the first in order
    firsts = with_null_safe(rows, broadcast_if_small(copies, 48, broadcast_limit), ["doc_id", "text_key"], "left_anti")
    lines = firsts.select("doc_id", "text_key", F.posexplode(content_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "text_key", F.col("pos").cast("long"), F.unhex(F.md5("line")).alias("digest"), F.size(F.split("line", "[ \t\r\x0b\x0c]+")).cast("long").alias("w")).distinct()
    again = lines.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    ranks = ordered_ranks(again, ["digest"], scratch, "lines")
    rows = lines.join(broadcast_if_small(ranks, 48, broadcast_limit), "digest").drop("digest").withColumnRenamed("rank", "line")

    # stretches of neighbouring repeated lines, and words before and after each line in its stretch
    rows = rows.withColumn("stretch", F.col("pos") - F.row_number().over(Window.partitionBy("text_key").orderBy("pos")))
    stretch = Window.partitionBy("text_key", "stretch")
    rows = rows.withColumn("upto", F.sum("w").over(stretch.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("w"))
    beyond = F.min("pos").over(stretch.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing))
    behind = F.max("pos").over(stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    rows = rows.select(
        "*", F.max("upto").over(stretch).alias("total"), F.max("pos").over(stretch).alias("last"), F.min("pos").over(stretch).alias("head"), beyond.alias("beyond"), behind.alias("behind")
    )
    stop = F.when(F.col("beyond").isNotNull(), F.col("beyond")).when(F.col("total") - F.col("before") >= min_words, F.col("last") + 1)
    start = F.when(F.col("upto") >= min_words, F.coalesce(F.col("behind") + 1, "head"))
    rows = rows.filter(F.col("total") >= min_words).select("doc_id", "text_key", "stretch", "pos", "line", stop.alias("stop"), start.alias("start"))
    rows = scratch.save(rows, "stretches")

    # where runs of just enough words begin, and how many lines they have
    forward = rows.filter("stop is not null").select("text_key", "pos", (F.col("stop") - F.col("pos")).alias("size"))
    backward = rows.filter("start is not null").select("text_key", F.col("start").alias("pos"), (F.col("pos") + 1 - F.col("start")).alias("size"))
    sizes = scratch.save(forward.unionByName(backward).groupBy("text_key", "pos").agg(F.sort_array(F.collect_set("size")).alias("sizes")), "sizes")
    longest = sizes.agg(F.max(F.array_max("sizes"))).first()[0] or 0

    ranked = suffix_ranks(rows.drop("stop", "start"), longest, scratch, broadcast_limit)
    ahead = Window.partitionBy("text_key", "stretch").orderBy("pos").rowsBetween(0, max(longest - 1, 0))
    ranked = ranked.withColumn("ids", F.collect_list("line").over(ahead)).join(sizes, ["text_key", "pos"])
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", F.col("pos").alias("begin"))
    ranked = scratch.save(ranked.select("text_key", "pos", "rank", place.alias("place"), "sizes", F.slice("ids", 1, F.array_max("sizes").cast("int")).alias("ids")), "array")
    classes = ranked.groupBy("rank").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.max("sizes").alias("sizes"), F.max("ids").alias("ids"))
    intervals = scratch.save(prefix_intervals(classes, scratch), "intervals")
    runs = ranked.select("text_key", F.col("pos").alias("begin"), "rank", "place", F.explode("sizes").alias("size"))
    later = runs.join(broadcast_if_small(intervals, 96, broadcast_limit), ["rank", "size"]).filter(F.col("place") != F.col("first"))
    later = later.select("text_key", "begin", (F.col("begin") + F.col("size")).alias("end"))

    # copies that touch or overlap are one maximal run
    earlier = Window.partitionBy("text_key").orderBy("begin", "end")
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.coalesce((F.col("begin") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(earlier))
    spans = island.groupBy("text_key", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    runs = scratch.save(spans.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")), "runs")
    scratch.drop("ids", "many", "lines-ranged", "lines", "stretches", "sizes", "array", "array-ranged", "entries-ranged", "entries", "intervals", *[f"level-{k}" for k in range(longest.bit_length() + 1)])
    return runs, copies


def delete_repeated_lines(
    docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """``docs`` with repeated runs deleted from the text, and the columns __n_lines, __n_removed and __spans.

    A run is one or more neighbouring non-blank lines with ``min_words`` words or more together. Of the places where it
    stands, the first in order of id and line stays. Lines are equal without regard to white space at their ends. A copy
    that overlaps the first place deletes all that comes after that place's first copy begins to repeat.

    Defined cases: a null text stays null and an empty one empty. A text equal to one with a smaller id loses all lines, if
    they have ``min_words`` words together; rows with the same id and text are one document. Null ids come last. Only the
    lines of deleted runs go, with the blank lines between them; what stays is untouched, to the byte. Spans count lines that
    are not blank. Columns of other names pass through; the three added ones replace columns of their names. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs, copies = repeated_runs(plain, scratch, min_words, broadcast_limit)

    rest = docs.drop("__n_lines", "__n_removed", "__spans")
    key, seen, raw, at, gone, spans = (free_prefix(rest) + name for name in ("key", "seen", "raw", "at", "gone", "spans"))
    keyed = rest.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    found = keyed.join(broadcast_if_small(runs.select(F.col("text_key").alias(key), F.col("spans").alias(spans)), 96, broadcast_limit), key, "left")
    # a text and an id that were seen before; repeated rows find the one row of theirs
    again = broadcast_if_small(copies.select(F.col("doc_id").alias(raw), F.col("text_key").alias(seen)), 48, broadcast_limit)
    found = found.join(again, (F.col(key) == F.col(seen)) & F.col(id_col).eqNullSafe(F.col(raw)), "left").drop(raw)
    found = found.withColumn(raw, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    bare = lambda i: F.trim(F.get(raw, i), F.lit(BLANKS))
    found = found.withColumn(at, F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: bare(i) != ""))  # where lines that are not blank stand
    words = F.aggregate(at, F.lit(0), lambda n, i: n + F.size(F.split(bare(i), "[ \t\r\x0b\x0c]+")))
    whole = F.col(seen).isNotNull() & (words >= min_words)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.size(at).cast("long").alias("end")))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    found = found.withColumn(spans, F.when(whole, everything).otherwise(F.coalesce(spans, none)))
    # blank lines between lines of one deleted run go with them
    edges = F.transform(spans, lambda s: F.struct(F.get(at, s["begin"].cast("int")).alias("lo"), F.get(at, (s["end"] - 1).cast("int")).alias("hi")))
    kept = F.filter(raw, lambda line, i: ~F.exists(gone, lambda g: (i >= g["lo"]) & (i <= g["hi"])))
    n_removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    found = found.withColumn(gone, edges)
    text = F.when(n_removed > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in rest.columns]
    return found.select(*columns, F.size(at).cast("long").alias("__n_lines"), n_removed.alias("__n_removed"), F.col(spans).alias("__spans"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, text, n_lines, n_removed, spans; see ``delete_repeated_lines``."""
    out = delete_repeated_lines(docs, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    return out.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__spans").alias("spans"))

"""Readings of texts from a lexicon of words, by the longest entry at each place."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators.shared import Workspace

#: Largest lexicon, in bytes of its entries, that is sent to the workers whole.
LEXICON_BYTES = 16 << 20

Node = dict  # a character to the next node; the reading of an entry that ends here under ""


def build_trie(entries: Iterable[tuple[str, str]]) -> Node:
    root: Node = {}
    for word, reading in entries:
        node = root
        for sign in word:
            node = node.setdefault(sign, {})
        node[""] = reading
    return root


def read_with(trie: Node, text: str, unknown: str, separator: str) -> str:
    """The readings of a text, joined by the separator; a character that begins no entry stands behind the mark ``unknown``."""
    out, at = [], 0
    while at < len(text):
        node, reading, end, i = trie, None, at, at
        while i < len(text) and (node := node.get(text[i])) is not None:
            i += 1
            if "" in node:
                reading, end = node[""], i
        out.append(unknown + text[at] if reading is None else reading)
        at = at + 1 if reading is None else end
    return separator.join(out)


def one_reading(lexicon: DataFrame) -> DataFrame:
    """word and reading, one row a word: of several readings the first in order. Words without characters or reading are left out."""
    return lexicon.filter("word <> '' AND reading IS NOT NULL").groupBy("word").agg(F.min("reading").alias("reading"))


def _by_trie(df: DataFrame, text: str, entries: DataFrame, name: str, unknown: str, separator: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(build_trie((r["word"], r["reading"]) for r in entries.collect()))  # measured before

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        trie = shared.value
        return texts.map(lambda t: None if t is None else read_with(trie, t, unknown, separator))

    return df.withColumn(name, read(F.col(text)))


def _by_join(df: DataFrame, text: str, entries: DataFrame, name: str, unknown: str, separator: str) -> DataFrame:
    """For lexicons beyond the limit: distinct texts' substrings of the lengths that entries have are joined with it."""
    work = Workspace(df.sparkSession)
    texts = work.save(df.select(F.col(text).alias("t")).filter("t IS NOT NULL").distinct(), "texts")
    lengths = [r["n"] for r in entries.select(F.length("word").alias("n")).distinct().orderBy("n").collect()]  # one a length
    at = F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at")
    spots = texts.filter("t <> ''").select("t", at).withColumn("n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
    spots = spots.filter("at + n - 1 <= length(t)").withColumn("word", F.expr("substring(t, at, n)"))
    longest = spots.join(entries, "word").groupBy("t", "at").agg(F.max_by(F.struct("n", "reading"), "n").alias("best"))
    known = longest.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("best"))  # a text's places

    def step(acc: Column, i: Column) -> Column:
        best = F.try_element_at("best", i)
        word = F.coalesce(best["reading"], F.concat(F.lit(unknown), F.col("t").substr(i, F.lit(1))))
        return F.when(i < acc["next"], acc).otherwise(F.struct(F.array_append(acc["out"], word).alias("out"), (i + F.coalesce(best["n"], F.lit(1))).alias("next")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"))
    places = F.when(F.length("t") > 0, F.sequence(F.lit(1), F.length("t"))).otherwise(F.array().cast("array<int>"))
    read = texts.join(known, "t", "left").select(F.col("t").alias("__t"), F.array_join(F.aggregate(places, start, step, lambda acc: acc["out"]), separator).alias("__read"))
    return df.drop(name).join(read, df[text] == F.col("__t"), "left").withColumn(name, F.col("__read")).drop("__t", "__read")


def with_readings(df: DataFrame, text: str, lexicon: DataFrame, name: str = "reading", limit: int = LEXICON_BYTES, unknown: str = "UNK:", separator: str = " ") -> DataFrame:
    """``df`` with the column ``name``: the readings of ``text`` from a lexicon of ``word`` and ``reading``.

    At each place the longest entry is read, whatever its length, and reading goes on behind it; a character that begins no
    entry stands behind the mark ``unknown``. A lexicon that measures less than ``limit`` is a trie on the workers, walked once for each place;
    a larger one is joined. Null texts have no reading, empty ones an empty reading.
    """
    entries = one_reading(lexicon)
    measured = entries.agg(F.sum(F.octet_length("word") + F.octet_length("reading") + 64)).first()[0] or 0
    return (_by_trie if measured <= limit else _by_join)(df, text, entries, name, unknown, separator)


def with_phrases(df: DataFrame, text: str, phrases: DataFrame, name: str, limit: int = LEXICON_BYTES) -> DataFrame:
    """``df`` with the column ``name``: ``text`` with each phrase, the longest at a place, in its other form; all else stays.

    ``phrases`` has word and reading, such as a dictionary from simplified to traditional words, single signs among them.
    """
    return with_readings(df, text, phrases, name, limit, unknown="", separator="")

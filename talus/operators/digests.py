"""Digests over ordered lists of values, without gathering a list anywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators.shared import Workspace

#: Characters of a chunk; a chunk is this long at most, or one value.
CHUNK = 8192


def _key(row: tuple, n: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in row[:n])


def ordered_chunks(rows: DataFrame, group: list[str], order: str, value: str, separator: str, work: Workspace) -> DataFrame:
    """group, __range, __place, text: each group's values in order, joined to chunks, which follow one another by range and place.

    Ranges of (group, order) are sorted apart, so values of one large group are put together by many tasks.
    """
    n, kinds = len(group), dict(rows.dtypes)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, now, parts, size, place = TaskContext.get().partitionId(), None, [], 0, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, text = _key(row, n), row[n]
                if key != now or size >= CHUNK:
                    if parts:
                        out.append((*now, task, place, separator.join(parts)))
                    place = place + 1 if key == now else 0
                    now, parts, size = key, [], 0
                parts.append(text)
                size += len(text)
            yield pd.DataFrame(out, columns=[*group, "__range", "__place", "text"])
        if parts:
            yield pd.DataFrame([(*now, task, place, separator.join(parts))], columns=[*group, "__range", "__place", "text"])

    given = rows.select(*group, F.col(value).cast("string").alias("__value"), F.col(order).alias("__order"))
    ranged = given.repartitionByRange(*group, "__order").sortWithinPartitions(*group, "__order").drop("__order")
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", __range int, __place long, text string"
    return work.save(ranged.mapInPandas(join, schema), "chunks")


def _folded(chunks: DataFrame, group: list[str], kinds: dict[str, str], start: Callable, name: str) -> DataFrame:
    """One row a group, from its chunks in order. ``start`` makes an object with ``add(row)`` and ``result()``; a row is group and rest."""
    n = len(group)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, running = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key = _key(row, n)
                if key != now:
                    if running:
                        out.append((*now, running.result()))
                    now, running = key, start()
                running.add(row[n:])
            yield pd.DataFrame(out, columns=[*group, name])
        if running:
            yield pd.DataFrame([(*now, running.result())], columns=[*group, name])

    rest = [c for c in chunks.columns if c not in (*group, "__range", "__place")]
    dealt = chunks.repartition(*group).sortWithinPartitions(*group, *[c for c in rest if c != "text"], "__range", "__place").select(*group, *rest)
    return dealt.mapInPandas(fold, ", ".join(f"`{g}` {kinds[g]}" for g in group) + f", {name} string")


class _Hash:
    def __init__(self, separator: str, headings: list[str]):
        self.hash, self.separator, self.headings, self.section = hashlib.sha256(), separator, headings, None

    def add(self, rest: tuple) -> None:
        section = int(rest[0]) if len(rest) > 1 else 0
        self.hash.update((self.separator if section == self.section else self.headings[section]).encode() + rest[-1].encode())
        self.section = section

    def result(self) -> str:
        return self.hash.hexdigest()


class _Text:
    def __init__(self, separator: str):
        self.separator, self.parts = separator, []

    def add(self, rest: tuple) -> None:
        self.parts.append(rest[-1])

    def result(self) -> str:
        return self.separator.join(self.parts)


def ordered_digests(rows: DataFrame, group: list[str], order: str, value: str, separator: str = ",", section: str | None = None, headings: tuple[str, ...] = ("",)) -> DataFrame:
    """One row a group: its columns and ``digest``, lower-case SHA-256 of its values in ``order``, joined by ``separator``.

    With ``section``, a column of numbers from 0, values are ordered by section first, and ``headings[section]`` stands before a
    section in place of a separator. The values of each range are joined by the task that sorted it; chunks of a group then
    pass, in order, through one running hash, so no list and no group is ever held whole. Null values are left out; groups
    without values have no row. Group columns are not null.
    """
    work, kinds = Workspace(rows.sparkSession), dict(rows.dtypes)
    chunks = ordered_chunks(rows.filter(F.col(value).isNotNull()), [*group, *([section] if section else [])], order, value, separator, work)
    return work.save(_folded(chunks, group, kinds, lambda: _Hash(separator, list(headings)), "digest"), "digests")


def ordered_texts(rows: DataFrame, group: list[str], order: str, value: str, separator: str = ",") -> DataFrame:
    """One row a group: its columns and ``text``, its values in ``order`` joined by ``separator``. A result is a cell, and as long as its values are."""
    work, kinds = Workspace(rows.sparkSession), dict(rows.dtypes)
    chunks = ordered_chunks(rows.filter(F.col(value).isNotNull()), group, order, value, separator, work)
    return work.save(_folded(chunks, group, kinds, lambda: _Text(separator), "text"), "texts")

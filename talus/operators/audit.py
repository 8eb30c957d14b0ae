"""Declarative checks: rules become issue rows, and issues become summaries."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from talus.functions.text import safe_id
from talus.operators.dedupe import require_rows


@dataclass(frozen=True)
class Check:
    """A row for which ``bad`` holds has an issue; unknown counts as no issue."""

    severity: str
    code: str
    bad: Column
    message: Column


def issues(df: DataFrame, checks: list[Check], key: str) -> DataFrame:
    """severity, code, key and message, in one pass over the rows."""
    found = F.array(*[F.when(F.coalesce(c.bad, F.lit(False)), F.struct(F.lit(c.severity).alias("severity"), F.lit(c.code).alias("code"), c.message.cast("string").alias("message"))) for c in checks])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(found)).alias("i")).select("i.severity", "i.code", "key", "i.message")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


def counts_map(found: DataFrame, column: str) -> DataFrame:
    """One row with a map from value to count, sorted by value."""
    counts = found.groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("n"))))).alias("counts"))


def expected_values(df: DataFrame, expected: dict[str, object], tolerance: float = 1e-4) -> list[Check]:
    """Checks that columns have expected values: numbers within the tolerance, others equal."""
    out = []
    for name, value in expected.items():
        c = F.col(name)
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        bad = F.abs(c.cast("double") - float(value)) > tolerance if number else c != F.lit(value)
        out.append(Check("error", f"{name}_mismatch", bad | c.isNull(), F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("missing")))))
    return out


def expectation_issues(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """severity, code, key and message for each cell that breaks a rule.

    ``rules`` is a table of ``column``, ``value`` (as text), ``tolerance`` and ``severity``. With a tolerance a cell must be a number within
    it of the value; without one its text must equal the value; a null value expects an empty cell. A missing cell, and a
    column that ``df`` does not have, break any other rule. Columns that rules name are unpivoted once and joined with the
    rules, so a rule is a row and no code.
    """
    # people write rules, so they are few
    named = [r["column"] for r in rules.select("column").distinct().orderBy("column").collect()]  # at most a table's columns, and typing errors
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias("cell")) for c in named])
    long = df.select(F.col(key).cast("string").alias("key"), F.explode(cells).alias("c")).select("key", "c.*")
    met = long.join(F.broadcast(rules.select("column", "value", "tolerance", "severity")), "column")
    number = F.abs(F.col("cell").try_cast("double") - F.col("value").try_cast("double")) <= F.col("tolerance")
    holds = F.when(F.col("value").isNull(), F.col("cell").isNull()).when(F.col("tolerance").isNotNull(), number).otherwise(F.col("cell") == F.col("value"))
    broken = met.filter(~F.coalesce(holds, F.lit(False)))
    message = F.concat(F.col("column"), F.lit(": "), F.coalesce("cell", F.lit("missing")))
    return broken.select("severity", F.concat("column", F.lit("_mismatch")).alias("code"), "key", message.alias("message"))


def frame_checks(arrays: dict[str, int], equal_length: list[str], tolerance: float = 1e-4) -> list[Check]:
    """Checks of frame arrays: present, of the given width, finite, equally long, and a residual that can be recomputed.

    Needs ``norm``, ``aligned`` and ``residual`` among the arrays for the last.
    """
    out = []
    for name, width in arrays.items():
        c = F.col(name)
        out += [
            Check("error", "missing_array", c.isNull() | (F.size(c) <= 0), F.lit(name)),
            Check("error", "bad_width", F.size(F.array_remove(F.transform(c, lambda f: F.size(f)), width)) > 0, F.lit(name)),
            Check("error", "not_finite", F.exists(c, lambda f: F.exists(f, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())), F.lit(name)),
        ]
    for name in equal_length[1:]:
        out.append(Check("error", "unequal_length", F.size(name) != F.size(equal_length[0]), F.lit(name)))
    if {"norm", "aligned", "residual"} <= set(arrays):
        again = F.zip_with(F.zip_with("aligned", "norm", lambda a, n: F.zip_with(a, n, lambda x, y: x - y)), F.col("residual"), lambda d, r: F.zip_with(d, r, lambda x, y: F.abs(x - y)))
        out.append(Check("error", "residual_mismatch", F.exists(again, lambda f: F.exists(f, lambda x: x > tolerance)), F.lit("residual")))
    return out


def path_checks(path: str, split: str, key: str, root: str) -> list[Check]:
    """A payload's path must be root/split/safe id, with any ending."""
    wanted = F.concat_ws("/", F.lit(root.rstrip("/")), F.col(split), safe_id(F.col(key).cast("string")))
    return [Check("error", "path_shape", F.col(path).isNull() | (F.regexp_replace(path, r"\.[^./]*$", "") != wanted), F.coalesce(F.col(path), F.lit("missing")))]


# Endings of the modules that presets below an encoder's prefix train.
PRESET_ENDS = {"attn_qkv": ("q_proj", "k_proj", "v_proj"), "attn_qkvo": ("q_proj", "k_proj", "v_proj", "out_proj"), "ffn": ("fc1", "fc2"), "all": ("",)}


def target_modules(modules: DataFrame, *, begins: tuple[str, ...] = (), ends: tuple[str, ...] = (), column: str = "name") -> DataFrame:
    """Names, sorted, that begin with one of ``begins`` and end with one of ``ends``; either may be left open. None is an error."""
    name = F.col(column)
    found = modules.select(column).distinct()
    for tests in ([name.startswith(b) for b in begins], [name.endswith(e) for e in ends]):
        if tests:
            found = found.filter(reduce(lambda a, b: a | b, tests))
    return require_rows(found, "selection of modules").orderBy(column)


class Progress(StreamingQueryListener):
    """Writes a JSON line to ``out`` for each micro-batch: its number, rows, groups that came too late, and seconds."""

    def __init__(self, out: Callable[[str], object] = print):
        self.out = out

    def onQueryStarted(self, event) -> None:  # noqa: N802 the listener's interface
        self.out(json.dumps({"event": "started", "id": str(event.id)}))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.out(json.dumps({"event": "progress", "batch": p.batchId, "rows": p.numInputRows, "late": late, "seconds": p.batchDuration / 1000}))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.out(json.dumps({"event": "ended", "id": str(event.id), "error": event.exception}))

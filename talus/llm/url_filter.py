"""URL allow and block lists: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import BROADCAST_LIMIT, ascii_lower

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class UrlTrie:
    """Nodes by host label from the right; at each host a trie over path segments.

    The last segment of a rule's path is a prefix of the url's segment, so the rule's path as a whole is a prefix of the
    url's path. Of all rules that fit, the one with most host labels wins, then the one with the longest path; of an
    allow and a block entry with the same host and path, block wins.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for rule in sorted(rules, key=lambda r: r.verdict == "block"):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            segments = node.setdefault(None, {"any": None, "open": {}, "next": {}})
            if not rule.path:
                segments["any"] = (rule.text, rule.verdict)
                continue
            *whole, last = rule.path.removeprefix("/").split("/")
            for segment in whole:
                segments = segments["next"].setdefault(segment, {"any": None, "open": {}, "next": {}})
            segments["open"][last] = (rule.text, rule.verdict)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = node["any"]
        if not path.startswith("/"):
            return best
        segments = path[1:].split("/")
        for i, segment in enumerate(segments):
            if opened := node["open"]:
                for end in range(min(len(segment), max(map(len, opened))) + 1):
                    best = opened.get(segment[:end], best)
            if i + 1 == len(segments) or (node := node["next"].get(segment)) is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if None in node:
                best = self._path(node[None], path) or best
        return best


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    The trie is broadcast once its pickled size is within ``broadcast_limit``; a larger rule set is joined by host
    suffix instead, with the same result. Where no rule fits, rule is null and the verdict is ``default``.

    Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule. Repeated rows and
    null ids pass through. Very long urls are judged whole. Further columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    trie = UrlTrie(rules)
    if len(pickle.dumps(trie)) > broadcast_limit:
        return _by_join(parts, rules, default)
    shared = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = shared.value.match
        for hosts, paths in batches:
            found = [match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return parts.withColumn("j", judged("host", "path")).select("page_id", "host", "path", "j.rule", "j.verdict")


def _by_join(parts: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """The same verdicts for rule sets too large to broadcast: hosts explode into their suffixes, as many as labels."""
    spark = parts.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "r_host string, r_path string, rule string, verdict string")
    hosts = parts.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")))
    best = (
        hosts.withColumn("r_host", suffix)
        .join(listed, "r_host")
        .filter(F.expr("startswith(path, r_path)"))
        .withColumn("rank", F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), F.col("verdict") == "block"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("j"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "j.rule", F.coalesce("j.verdict", F.lit(default)).alias("verdict")
    )

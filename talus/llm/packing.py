"""Packing token sequences: cutting-stock by column generation over a histogram of piece lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import Scratch, releasing, small_batches

PIECES = "pid long, idx long, doc_id string, start long, length long, ids_crc32 long, doc_tokens long"

# Letters of ASCII and of the Latin blocks up to U+024F; texts with other non-ASCII characters go to the tokenizer whole.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = r"\t-\r "
_ASCII_PIECE = re.compile(
    rf" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[!-/:-@\[-`{{-~\x00-\x08\x0e-\x1f\x7f]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_LATIN_PIECE = re.compile(
    rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OTHER = re.compile(f"[^\x00-\x7f{_LATIN}]")


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 is itself, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes; as a dictionary, those of pieces met before.

    Byte-level BPE never merges across the pieces of its pre-tokenizer, so each distinct piece is encoded once and
    remembered, up to ``memo`` pieces; then the memo starts anew. Where the vocabulary numbers its merges in their order,
    as this format does, a piece is encoded by rank with ``tiktoken``; otherwise by ``tokenizers`` itself. The tokenizer is
    given by its file, or by the file's text where the file is not at hand.
    """

    def __init__(self, tokenizer_path: str | None, memo: int = 500_000, definition: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        definition = definition or Path(tokenizer_path).read_text(encoding="utf-8")
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo = memo
        self.encode_piece = self._ranked(definition) or self._encode

    def _ranked(self, definition: str):
        model = json.loads(definition)["model"]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
        if not all(vocab.get(m) == 256 + i for i, m in enumerate(merged)):
            return None
        from tiktoken import Encoding

        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items()}
        core = Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda piece: array("I", core.encode_single_piece(piece.encode())).tobytes()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memo:
            self.clear()
        found = self[piece] = self.encode_piece(piece)
        return found

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self._encode(text)
        known, out = self.__getitem__, []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(map(known, (_ASCII_PIECE if part.isascii() else _LATIN_PIECE).findall(part)))
        return b"".join(out)


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity``, the best value of an unbounded knapsack, and the size to take first (0: leave one open)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth, least = np.full(capacity + 1, -np.inf), int(sizes.min())
    worth[sizes] = value[sizes]
    worth = worth[least:]  # of the shortest size and all longer ones
    for room in range(least, capacity + 1):
        gain = worth[: room - least + 1] + best[room - least :: -1]
        k = int(gain.argmax())
        best[room], choice[room] = (gain[k], k + least) if gain[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    return best, choice


def _taken(choice: np.ndarray, room: int) -> Counter[int]:
    pattern: Counter[int] = Counter()
    while room > 0:
        if s := int(choice[room]):
            pattern[s] += 1
        room -= s or 1
    return pattern


def solve_linear_program(demand: dict[int, int], capacity: int, tolerance: float = 1e-4, max_rounds: int = 2000) -> tuple[dict[int, float], list[tuple[Counter[int], float]]]:
    """The cutting-stock program over patterns of sizes: the price of each size, and the basis' patterns with their levels.

    Column generation: a revised simplex keeps the basis inverse, and a knapsack by dynamic programming prices the next
    pattern, until the bound on what is left to gain is below the tolerance.
    """
    sizes = sorted((s for s, n in demand.items() if n > 0), reverse=True)
    m, need = len(sizes), np.array([demand[s] for s in sizes], float)
    size, place = np.array(sizes), {s: i for i, s in enumerate(sizes)}
    columns = np.diag(capacity // size).astype(float)
    # products are spelled out: threaded BLAS may hang in a process that has started a JVM
    inverse, level = np.diag(1.0 / (capacity // size)), need / (capacity // size)
    by_size = np.zeros(capacity + 1)
    for _ in range(max_rounds):
        by_size[size] = np.maximum(inverse.sum(axis=0), 0.0)  # duals, as each pattern costs one
        best, choice = _knapsack(by_size, size, capacity)
        used_now = level.sum()
        if used_now - used_now / max(best[capacity], 1.0) <= max(tolerance * used_now, 1e-6):  # bound on what is left to gain
            break
        pattern = np.zeros(m)
        for s, n in _taken(choice, capacity).items():
            pattern[place[s]] = n
        step = (inverse * pattern).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, level / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        level = np.maximum(level - theta * step, 0.0)
        level[out] = theta
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = pattern
    prices = {s: max(float(p), 0.0) for s, p in zip(sizes, inverse.sum(axis=0), strict=True)}
    basis = [(Counter({sizes[i]: int(columns[i, j]) for i in np.nonzero(columns[:, j])[0]}), float(level[j])) for j in np.argsort(-level)]
    return prices, basis


def round_down(basis: list[tuple[Counter[int], float]], left: dict[int, int]) -> Counter[tuple[int, ...]]:
    """The basis' patterns as often as whole numbers allow; what they pack is taken out of ``left``."""
    used: Counter[tuple[int, ...]] = Counter()
    for pattern, level in basis:
        times = min([int(level + 1e-6), *(left[s] // n for s, n in pattern.items())]) if pattern else 0
        if times > 0:
            for s, n in pattern.items():
                left[s] -= times * n
            used[tuple(sorted(pattern.elements(), reverse=True))] += times
    return used


def generate_patterns(demand: dict[int, int], price: np.ndarray, capacity: int, longest_first: bool) -> Counter[tuple[int, ...]]:
    """Patterns for all of the demand by prices.

    Each round prices exact lengths by one knapsack and reads patterns from it, longest length first: the length and the
    best that its room holds, as often as there are pieces for it. ``longest_first``: where pieces have run out, the round ends
    a sixteenth of the capacity further down, as shorter lengths should not take what the longer ones need. Otherwise a
    round takes whatever patterns are worth as much as the best, but for a hundredth. In the knapsack prices are raised a
    little with the square of the length, so of patterns worth the same the one of longer pieces comes first and short ones
    stay for the last gaps.
    """
    left = dict(demand)
    used: Counter[tuple[int, ...]] = Counter()
    value = price + 1e-3 * (np.arange(capacity + 1) / capacity) ** 2

    def use(pattern: Counter[int]) -> bool:
        times = min(left[s] // n for s, n in pattern.items())
        if times:
            for s, n in pattern.items():
                left[s] -= times * n
            used[tuple(sorted(pattern.elements(), reverse=True))] += times
        return times > 0

    while sizes := sorted((s for s, n in left.items() if n > 0), reverse=True):
        _, choice = _knapsack(value, np.array(sizes), capacity)
        held = [0.0]  # for each room, what its best filling is worth without the squares
        for room, s in enumerate(choice[1:].tolist(), 1):
            held.append(held[room - s] + price[s] if s else held[room - 1])
        good = 0.0 if longest_first else max(price[s] + held[capacity - s] for s in sizes) - 0.01
        found, stop = False, 0
        for s in sizes:
            if s < stop:
                break
            if price[s] + held[capacity - s] < good:
                continue
            while left[s] and use(_taken(choice, capacity - s) + Counter([s])):
                found = True
            if longest_first and left[s] and not stop:
                stop = s - capacity // 16
        if not found:  # no pattern has pieces enough: one sequence of the longest piece and what is there for its room
            filling, room = Counter[int](), capacity
            for s in sizes:
                if n := min(left[s], room // s):
                    filling[s], room = n, room - n * s
            use(filling)
    return used


def pack_lengths(demand: dict[int, int], capacity: int, grain: int = 8, most_exact: int = 512) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of exact lengths, and how often each is used; together they hold exactly the demand.

    The program is always solved by the simplex: up to ``most_exact`` lengths are its classes themselves, and its patterns are
    used as often as its solution, rounded down, says; more lengths are classes of ``grain``, whose prices are drawn out to
    exact lengths. What remains is packed by further patterns at the program's prices. Where rounding leaves much, patterns
    for all of the demand at these prices may be better. They are generated in two orders; the plan of fewest sequences is taken.
    """
    left = {s: n for s, n in demand.items() if n > 0}
    if not left:
        return []
    starts = [(Counter(), dict(left))]
    if len(left) <= most_exact:
        prices, basis = solve_linear_program(left, capacity)
        starts.append((round_down(basis, left), left))
    else:
        classes: Counter[int] = Counter()
        for s, n in left.items():
            classes[max(1, round(s / grain))] += n
        prices = {c * grain: p for c, p in solve_linear_program(classes, capacity // grain)[0].items()}
    known = sorted(prices)
    price = np.interp(np.arange(capacity + 1), [0, *known], [0.0, *(prices[s] for s in known)])
    plans = [used + generate_patterns(rest, price, capacity, order) for used, rest in starts for order in (False, True)]
    return list(min(plans, key=Counter.total).items())


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    grain: int = 8,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens and the end id are cut into pieces of ``capacity`` and a remainder. The histogram of lengths, at
    most ``capacity`` numbers, is all that reaches the driver; ``grain`` is the width of the program's classes there, where
    there are too many lengths for exact ones. The patterns of exact lengths are dealt to the pieces by rank within their length. Ranks come from counters kept
    while writing the pieces and from sums over the writing tasks, so no length meets in one task.

    Defined cases: a null text counts as empty and yields the end id alone. Repeated ids and rows are packed as often as
    they occur; a null id stays null, and ids may be of any type. Further columns are ignored; an empty table gives an empty result.
    """
    if capacity % grain:
        raise ValueError("grain must divide capacity")
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")

    # a vocabulary file of a few MB, which need not be on the executors
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, counters, pid = TokenBytes(None, definition=definition.value).encode, Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                raw = encode(text or "") + end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    rows.append((pid, counters[length], doc_id, start, length, zlib.crc32(part), total))
                    counters[length] += 1
            yield pd.DataFrame(rows, columns=["pid", "idx", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        pieces = scratch.save(source.mapInPandas(releasing(cut), PIECES), "pieces")

    per_task = scratch.save(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "per_task")
    demand = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    # slots: for each length and pattern, the ranks it takes, in runs of equal patterns
    slots, taken, first_sequence = [], Counter(), 0
    for pattern, times in pack_lengths(demand, capacity, grain):
        position = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            slots.append(((length << 40) + taken[length], each, first_sequence, position))
            taken[length] += times * each
            position += each
        first_sequence += times
    # the slots follow the number of lengths, not the corpus
    shared = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 4).T.copy())

    @F.pandas_udf("sequence_id long, slot long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lo, each, first, position = shared.value
        key = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        at = np.searchsorted(lo, key, "right") - 1
        past = key - lo[at]
        return pd.DataFrame({"sequence_id": first[at] + past // each[at], "slot": position[at] + past % each[at]})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("pid", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["pid", "length"]).withColumn("place", place("length", F.col("base") + F.col("idx")))
    placed = ranked.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "place.*")
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long").alias("offset"),
    )

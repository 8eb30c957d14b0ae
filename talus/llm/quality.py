"""Quality classifier: a byte-level convolutional network in numpy.

Filters slide over the bytes of a text. Overlapping chunks cover the whole of it; each chunk keeps every filter's maximum,
and the mean and the maximum over the chunks enter one logistic unit. The filters, as a table by place and byte value,
are learned together with that unit; a maximum passes its gradient to the bytes where it was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import Scratch, small_batches
from talus.llm.labelled import id_bucket, labelled_sample

#: Bytes a filter sees; bytes a block; blocks a chunk, and how many blocks further the next chunk begins.
WIDTH, BLOCK, CHUNK, STEP = 6, 64, 4, 3
#: Bytes convolved at once.
SLICE = 1 << 18


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, blocks of each, and the places in blocks past a text's end.

    Each text is padded with zeros to whole blocks and by one more block, which is no part of it: it keeps filters at a
    text's end from reaching into the next text. No filter begins past a text's end; an empty text has one place.
    """
    sizes = np.array([len(t) for t in texts])
    blocks = np.maximum(-(-sizes // BLOCK), 1) + 1
    first = (np.cumsum(blocks) - blocks) * BLOCK
    past = [np.arange(a + max(n, 1), a + (k - 1) * BLOCK) for a, n, k in zip(first.tolist(), sizes.tolist(), blocks.tolist(), strict=True)]
    return np.frombuffer(b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True)), np.uint8), blocks, np.concatenate(past)


@dataclass
class ByteConvNet:
    """``table``: weight by place, byte and filter; ``mean`` and ``most``: weights of the pooled filters."""

    table: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    most: np.ndarray
    shift: float

    def blocks(self, data: np.ndarray, past: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum in each block, and where it was found. A block's last filters reach into the next block."""
        n, filters = len(data) // BLOCK, self.table.shape[2]
        best, where = np.empty((n, filters), np.float32), np.empty((n, filters), np.int64) if places else None
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        for start in range(0, len(data), SLICE):
            part = padded[start : start + SLICE + WIDTH - 1]
            count = min(SLICE, len(data) - start)
            z = self.table[0].take(part[:count], axis=0)
            for k in range(1, WIDTH):
                z += self.table[k].take(part[k : k + count], axis=0)
            z[past[np.searchsorted(past, start) : np.searchsorted(past, start + count)] - start] = -np.inf
            z = z.reshape(-1, BLOCK, filters)
            rows = slice(start // BLOCK, (start + count) // BLOCK)
            if places:
                at = z.argmax(axis=1)
                where[rows] = at + (np.arange(start, start + count, BLOCK))[:, None]
                best[rows] = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
            else:
                best[rows] = z.max(axis=1)
        return best + self.bias, where

    def pooled(self, data: np.ndarray, blocks: np.ndarray, past: np.ndarray, places: bool = False):
        """Filters by chunk, the document of each chunk, and the places behind them."""
        best, where = self.blocks(data, past, places)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        own = blocks - 1
        chunks = np.maximum(-(-(own - CHUNK) // STEP), 0) + 1
        doc = np.repeat(np.arange(len(blocks)), chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start, stop = first[doc] + STEP * nth, (first + own - 1)[doc]
        members = np.minimum(start[:, None] + np.arange(CHUNK), stop[:, None])
        held = best[members]
        top = held.argmax(axis=1)
        value = np.take_along_axis(held, top[:, None, :], axis=1)[:, 0]
        at = np.take_along_axis(where[members], top[:, None, :], axis=1)[:, 0] if places else None
        return np.maximum(value, 0), doc, chunks, at

    def logits(self, texts: list[bytes]) -> np.ndarray:
        value, _, chunks, _ = self.pooled(*_buffer(texts))
        at = np.cumsum(chunks) - chunks
        mean = np.add.reduceat(value, at, axis=0) / chunks[:, None]
        most = np.maximum.reduceat(value, at, axis=0)
        return (mean * self.mean).sum(axis=1) + (most * self.most).sum(axis=1) + self.shift

    def scores(self, texts: list[str], group: int = 1 << 20) -> list[float]:
        """Probabilities; texts are taken in groups of about ``group`` bytes, a longer text alone and in slices."""
        out, held, size = [], [], 0
        for text in [*texts, None]:
            if held and (text is None or size >= group):
                out += (1 / (1 + np.exp(-np.clip(self.logits(held), -30, 30)))).tolist()
                held, size = [], 0
            if text is not None:
                held.append(text.encode("utf-8", "replace"))
                size += len(held[-1])
        return out


def train_byte_conv_net(texts: list[str], labels: list[int], counts: dict[int, int], *, filters: int = 12, epochs: int = 16, batch: int = 48, rate: float = 0.03, seed: int = 11) -> ByteConvNet:
    """Filters and output unit together, by Adam on whole documents, classes weighted to their true shares' square root.

    Without texts of both classes every score is the share of label 1, or 0 without labels.
    """
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    rng = np.random.default_rng(seed)
    net = ByteConvNet(np.zeros((WIDTH, 256, filters), np.float32), np.zeros(filters, np.float32), np.zeros(filters), np.zeros(filters), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if len(set(labels)) < 2:
        return net
    net.table = rng.normal(0, 0.3, net.table.shape).astype(np.float32)
    net.mean, net.most = rng.normal(0, 0.3, filters), rng.normal(0, 0.3, filters)
    y = np.array(labels, float)
    raw = [t.encode("utf-8", "replace") for t in texts]
    sampled = {c: max((y == c).sum(), 1) for c in (0, 1)}
    weight = np.array([np.sqrt((share if c else 1 - share) / sampled[c] * len(y) * 0.5 * len(y) / sampled[c]) for c in y])
    weight /= weight.mean()
    names = ("table", "bias", "mean", "most", "shift")
    moments = {n: [0.0, 0.0] for n in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            data, blocks, past = _buffer([raw[i] for i in rows])
            value, doc, chunks, at = net.pooled(data, blocks, past, places=True)
            first = np.cumsum(chunks) - chunks
            mean = np.add.reduceat(value, first, axis=0) / chunks[:, None]
            most = np.maximum.reduceat(value, first, axis=0)
            logit = (mean * net.mean).sum(axis=1) + (most * net.most).sum(axis=1) + net.shift
            dz = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            is_top = (value == most[doc]) & (value > 0)
            ties = np.maximum(np.add.reduceat(is_top.astype(float), first, axis=0), 1)
            dvalue = dz[doc, None] * (net.mean / chunks[doc, None] + net.most * is_top / ties[doc]) * (value > 0)
            seen = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            flat = np.concatenate([((k * 256 + seen[at + k].astype(np.int64)) * filters + np.arange(filters)).ravel() for k in range(WIDTH)])
            grads = {
                "table": np.bincount(flat, weights=np.tile(dvalue.ravel(), WIDTH), minlength=net.table.size).reshape(net.table.shape) + 1e-5 * net.table,
                "bias": dvalue.sum(axis=0),
                "mean": (dz[:, None] * mean).sum(axis=0) + 1e-4 * net.mean,
                "most": (dz[:, None] * most).sum(axis=0) + 1e-4 * net.most,
                "shift": dz.sum(),
            }
            step += 1
            lr = rate * (1 - epoch / epochs) + 0.002
            for n, g in grads.items():
                m = moments[n][0] = 0.9 * moments[n][0] + 0.1 * g
                v = moments[n][1] = 0.99 * moments[n][1] + 0.01 * g * g
                value_now = getattr(net, n)
                new = value_now - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                setattr(net, n, new.astype(value_now.dtype) if isinstance(value_now, np.ndarray) else float(new))
    return net


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    modulus: int = 5,
    held_out: int = 0,
    per_class: int = 800,
    max_bytes: int = 5 << 20,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The network is fitted on a sample bounded by ``per_class`` documents and ``max_bytes`` of text, from ids that are not
    held out; then all bytes of every text are scored. Ids, languages and sources are no inputs of a score.

    Defined cases: a null text counts as empty and has the score of blank bytes. A null id is not held out. Repeated rows
    are scored alike. Without labels the score is 0, without a second class the share of label 1. Very long texts are scored
    whole, chunk by chunk. Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts, y, counts = labelled_sample(
        docs, labels, label_col, modulus=modulus, held_out=held_out, per_class=per_class, max_bytes=max_bytes, id_col=id_col, text_col=text_col
    )
    model = spark.sparkContext.broadcast(train_byte_conv_net(texts, y, counts))  # a table of fixed size

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": model.value.scores([t or "" for t in batch["text"]])})

    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.coalesce(id_bucket(F.col(id_col), modulus) == held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    with small_batches(spark):
        found = Scratch(spark, "quality").save(rows.mapInPandas(scored, "doc_id string, held_out boolean, score double"), "scores")
    return found.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

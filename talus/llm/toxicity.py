"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of itself and its character n-grams, a window the average of its words, and a
two-class softmax over the window gives its logit. As all of that is linear, a subword counts with one number once the
model is trained: its vector times the difference of the two class vectors. Averaged over a whole text, a few words vanish in a
long one (README has the figures); so a document's score weighs the logit of its average and that of its worst window.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import Scratch, release_memory, releasing, small_batches
from talus.llm.labelled import id_bucket, labelled_sample

WORD = re.compile(r"\w+")


def subwords(words: list[str], bits: int, lengths: range) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of words and of their character n-grams, with marks at the ends, and which word each belongs to."""
    sizes = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)]
    owners = [np.arange(len(words))]
    for n in lengths:
        end = len(codes) - n + 1
        if end <= 0:
            continue
        inside = owner[:end] == owner[n - 1 :]
        h = np.full(end, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + codes[k : end + k]
        hashes.append(h[inside])
        owners.append(owner[:end][inside])
    mixed = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


@dataclass
class SubwordBag:
    """``weight``: for each bucket, its vector times the difference of the class vectors."""

    weight: np.ndarray
    scale: float
    shift: float
    mean_scale: float = 0.0
    window: int = 4
    lengths: range = range(3, 6)
    memo: int = 300_000

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words or self.bits == 0:
            return np.zeros(len(words))
        bucket, owner = subwords(words, self.bits, self.lengths)
        return np.bincount(owner, weights=self.weight[bucket], minlength=len(words)) / np.bincount(owner, minlength=len(words))

    @property
    def bits(self) -> int:
        return len(self.weight).bit_length() - 1

    def scorer(self):
        """A function from texts to scores, which remembers the logits of words."""
        known: dict[str, float] = {}

        def score(texts: list[str]) -> list[float]:
            split = [WORD.findall(t.lower()) for t in texts]
            if len(known) > self.memo:
                known.clear()
            new = [w for w in set().union(*split) if w not in known]
            known.update(zip(new, self.word_logits(new).tolist(), strict=True))
            get = known.__getitem__
            return [self.from_words(np.fromiter(map(get, words), float, len(words))) for words in split]

        return score

    def from_words(self, values: np.ndarray) -> float:
        """Probability from the logits of a text's words; a text without words has that of a neutral window."""
        worst, mean = self.features(values)
        return float(1 / (1 + np.exp(-np.clip(self.scale * worst + self.mean_scale * mean + self.shift, -30, 30))))

    def features(self, values: np.ndarray) -> tuple[float, float]:
        """Logits of the worst window and of the average over the text."""
        n = len(values)
        if not n:
            return 0.0, 0.0
        sums = np.concatenate([[0.0], np.cumsum(values)])
        width = min(self.window, n)
        return float((sums[width:] - sums[:-width]).max() / width), float(sums[-1] / n)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Scales of the features and shift of a weighted logistic regression, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    keep = np.diag([ridge] * x.shape[1] + [1e-9])
    theta = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip((z * theta).sum(axis=1), -30, 30)))
        slope = (z * (w * (p - y))[:, None]).sum(axis=0) + keep.diagonal() * theta
        curve = np.einsum("ni,n,nj->ij", z, w * p * (1 - p) + 1e-9, z) + keep
        step = np.linalg.solve(curve, slope)
        theta = theta - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return theta


def _words_of(texts: list[str], order: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts in the given order as numbers in one array, and how many each text has."""
    number: dict[str, int] = {}
    flat, sizes = array("i"), np.zeros(len(order), np.int64)
    for at, i in enumerate(order):
        before = len(flat)
        flat.extend(number.setdefault(w, len(number)) for w in WORD.findall(texts[i].lower()))
        sizes[at] = len(flat) - before
    return [*number], np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), sizes


def _subword_table(words: list[str], bits: int, lengths: range, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word by word, and where each word's begin; numbered in steps to keep what is held small."""
    parts, counts = [], []
    for s in range(0, len(words), step):
        bucket, owner = subwords(words[s : s + step], bits, lengths)
        order = np.argsort(owner, kind="stable")
        parts.append(bucket[order].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(words[s : s + step])))
    sizes = np.concatenate(counts)
    return np.concatenate(parts), np.cumsum(sizes) - sizes


def _sums(into: np.ndarray, of: np.ndarray, value: np.ndarray, size: int, step: int = 1 << 18) -> np.ndarray:
    """For each number in ``into`` the sum of the values that ``of`` names beside it; in steps, to keep what is held small."""
    out = np.zeros(size)
    for s in range(0, len(into), step):
        out += np.bincount(into[s : s + step], weights=value[of[s : s + step]], minlength=size)
    return out


def train_subword_bag(texts: list[str], labels: list[int], counts: dict[int, int], *, buckets: int = 1 << 17, dim: int = 8, rounds: int = 250, min_texts: int = 3, doubted: float = 0.05, seed: int = 7) -> SubwordBag:
    """Vectors and softmax trained together by Adam on whole texts.

    For the first third of the rounds each window has its document's label. Then a toxic document teaches by its worst
    window alone, while clean ones teach by all; of the toxic documents the share ``doubted`` whose worst windows are the
    least toxic teach nothing, as labels may be wrong. Subwords of fewer than ``min_texts`` texts stay neutral. A fifth of
    the texts is kept to turn worst windows and averages into probabilities at the classes' true shares. Without texts with words of both
    classes the score is the share of label 1, or 0 without labels.
    """
    y = np.array(labels)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    neutral = SubwordBag(np.zeros(1, np.float32), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if len(set(labels)) < 2:
        return neutral
    model = SubwordBag(np.zeros(buckets, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2:
        held[:] = False
    order = np.argsort(held, kind="stable")  # texts to learn from come first
    y, n_fit = y[order], int((~held).sum())
    words, index, sizes = _words_of(texts, order)
    begin = np.cumsum(sizes) - sizes
    n_windows = -(-sizes[:n_fit] // model.window)
    if not n_windows.sum():
        return neutral
    flat, word_at = _subword_table(words, model.bits, model.lengths)
    spread = np.diff(np.append(word_at, len(flat)))
    fit = index[: sizes[:n_fit].sum()]
    owner = np.repeat(np.arange(n_fit), n_windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = begin[owner] + model.window * nth
    lens = np.minimum(model.window, begin[owner] + sizes[owner] - at)
    target = y[owner].astype(np.float32)
    doc_at = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1])
    doc_rows, doc_y = np.diff(np.append(doc_at, len(owner))), target[doc_at]
    if len(set(doc_y.tolist())) < 2:
        return neutral

    known = np.zeros(buckets, np.int32)  # texts that have a subword
    for i in range(n_fit):
        own = np.unique(index[begin[i] : begin[i] + sizes[i]])
        if len(own):
            known[np.unique(np.concatenate([flat[word_at[w] : word_at[w] + spread[w]] for w in own]))] += 1
    # other subwords stay neutral: they have no vector and add nothing to a sum over a word
    taught = np.nonzero(known >= min_texts)[0]
    number, learnt = np.cumsum(known >= min_texts) - 1, known[flat] >= min_texts
    of_word, learnt_flat = np.repeat(np.arange(len(words), dtype=np.int32), spread)[learnt], number[flat[learnt]].astype(np.int32)

    vectors, u, bias = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)[taught], rng.normal(0, 1.0, dim), 0.0
    rates, floor = (0.05, 0.05, 0.05), 0.05
    moments = [np.zeros_like(vectors), np.zeros_like(vectors), np.zeros(dim), np.zeros(dim), 0.0, 0.0]
    for t in range(1, rounds + 1):
        q = (vectors * u.astype(np.float32)).sum(axis=1)
        word = _sums(of_word, learnt_flat, q, len(words)) / spread
        logit = np.add.reduceat(word[fit], at) / lens + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        weight = np.ones(len(owner))
        if t > rounds // 3:
            worst = np.maximum.reduceat(logit, doc_at)
            least = np.quantile(worst[doc_y == 1], doubted)
            top = np.repeat(np.where((doc_y == 1) & (worst < least), np.inf, worst), doc_rows)
            weight[(target == 1) & (logit < top)] = 0.0
        for label in (0, 1):
            weight[target == label] /= max(weight[target == label].sum(), 1e-9) * 2
        dz = weight * (p - target)
        dword = np.bincount(fit, weights=np.repeat(dz / lens, lens), minlength=len(words)) / spread
        db = _sums(learnt_flat, of_word, dword, len(taught)).astype(np.float32)
        grads = (db[:, None] * u.astype(np.float32) + np.float32(1e-8) * vectors, (db[:, None] * vectors).sum(axis=0) + 1e-6 * u, dz.sum())
        new = []
        for k, (value, grad) in enumerate(zip((vectors, u, bias), grads, strict=True)):
            m = moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            v = moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad * grad
            # the floor under the divisor keeps subwords that are rare, and so have small gradients, near zero
            root = np.sqrt(v / (1 - 0.99**t))
            new.append(value - rates[k] * (m / (1 - 0.9**t)) / (root + floor * np.max(root, initial=0) + 1e-12))
        vectors, u, bias = new

    model.weight[taught] = (vectors * u).sum(axis=1).astype(np.float32)
    q = np.add.reduceat(model.weight[flat], word_at) / spread
    features = np.array([model.features(q[index[b : b + n]]) for b, n in zip(begin, sizes, strict=True)])
    on = np.arange(len(y)) >= n_fit if held.any() else np.ones(len(y), bool)
    of_class = {c: max((y[on] == c).sum(), 1) for c in (0, 1)}
    weights = np.array([(share if c else 1 - share) / of_class[c] for c in y[on]]) * on.sum()
    # averages vary less than worst windows; brought to the same spread, the ridge holds both alike
    spans = np.maximum(features[on].std(axis=0), 1e-6)
    scales = _logistic(features[on] / spans, y[on].astype(float), weights)
    (model.scale, model.mean_scale), model.shift = (scales[:2] / spans).tolist(), float(scales[2])
    return model


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    modulus: int = 4,
    held_out: int = 2,
    per_class: int = 3000,
    max_bytes: int = 16 << 20,
    key_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and ``key_col`` as text where it is given.

    The model is fitted on a sample bounded by ``per_class`` documents and ``max_bytes`` of text, from ids that are not
    held out; then every whole text is scored. Ids, languages and sources are no inputs of a score.

    Defined cases: a null or wordless text has the score of a neutral window. A null id is not held out. Repeated rows are
    scored alike. Without labels the score is 0, without a second class the share of label 1. Very long texts are scored
    whole; in the sample, one that passes the bound is left out. Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts, y, counts = labelled_sample(
        docs, labels, label_col, modulus=modulus, held_out=held_out, per_class=per_class, max_bytes=max_bytes, id_col=id_col, text_col=text_col
    )
    trained = train_subword_bag(texts, y, counts)
    del texts
    release_memory()
    model = spark.sparkContext.broadcast(trained)  # one number a bucket

    keys = [key_col] if key_col else []

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.value.scorer()
        for batch in batches:
            yield batch.assign(score=score([t or "" for t in batch["text"]])).drop(columns="text")

    rows = docs.select(
        *[F.col(c).cast("string").alias(c) for c in keys],
        F.col(id_col).cast("string").alias("doc_id"),
        F.coalesce(id_bucket(F.col(id_col), modulus) == held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    with small_batches(spark):
        found = Scratch(spark, "toxicity").save(rows.mapInPandas(releasing(scored), "".join(f"`{c}` string, " for c in keys) + "doc_id string, held_out boolean, score double"), "scores")
    return found.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keys
    )

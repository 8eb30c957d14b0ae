"""Expressions against plain Python, on edge cases and random strings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import casts, frames, metrics, text

ALPHABET = list("ab,.。 　 \x1c\n/12?!") + list("零〇一二兩三九十百千廿卅啱岩咩嘢野钟意汉") + ["𝒳"]


def words(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12))) for _ in range(n)]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}").orderBy("__i").select(*columns).collect()]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cer_counts_code_points(spark):
    a, b = words(seed=1), words(seed=2)
    got = values(spark, list(zip(a, b)), "a string, b string", metrics.cer(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == pytest.approx([distance(x, y) / max(1, len(x)) for x, y in zip(a, b)])


def test_basic_normalisation(spark):
    rows = words()
    drop = str.maketrans("", "", text.PUNCTUATION)
    got = values(spark, [(w,) for w in rows], "a string", text.normalize_basic(F.col("a")))
    assert [g[0] for g in got] == [re.sub(r"\s+", "", w).translate(drop) for w in rows]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("廿五", "25"), ("卅一", "31"), ("一廿", "一廿"), ("廿", "廿"), ("十百", "110"), ("一百零五", "105"), ("二〇二四", "2024"), ("一", "一"), ("十", "十"), ("十二a三千", "12a3000"), ("", "")],
)
def test_numerals(spark, given, wanted):
    assert values(spark, [(given,)], "a string", text.normalize_numerals(F.col("a"))) == [(wanted,)]


def test_full_normalisation_applies_replacements_in_order(spark):
    got = values(spark, [("岩岩 A",), ("咩野",), ("我的钟",)], "a string", text.normalize_full(F.col("a")))
    assert [g[0] for g in got] == ["啱a", "乜嘢", "我嘅鍾"]


def test_reference_cleaning(spark):
    given = ["[ 1. 你好，世界 /abc1/ ]", "（２）早晨", "  ", "3、食飯未？", None]
    got = values(spark, [(g,) for g in given], "a string", text.clean_reference(F.col("a")), text.is_numbered_question(F.col("a")))
    assert [got[i][0] for i in (0, 2, 3, 4)] == ["你好世界", "", "食飯未", ""]
    assert got[3][1] is True and got[0][1] is False


def test_casts(spark):
    given = ["", "1", "true", "No", "maybe", None, "2.5"]
    got = values(spark, [(g,) for g in given], "a string", casts.optional_double(F.col("a")), casts.flag(F.col("a")), casts.flag_or_null(F.col("a")), casts.flag_three_valued(F.col("a")))
    assert [g[0] for g in got] == [None, 1.0, None, None, None, None, 2.5]
    assert [g[1] for g in got] == [False, True, True, False, False, False, False]
    assert [g[2] for g in got] == [None, True, True, False, False, None, False]
    assert [g[3] for g in got] == [None, True, True, False, None, None, None]


def test_number_text_rounds_half_to_even(spark):
    got = values(spark, [(0.0000005,), (0.0000015,), (None,), (float("nan"),)], "a double", casts.number_text(F.col("a")))
    assert [g[0] for g in got] == ["0.000000", "0.000002", "", ""]


def test_buckets_and_flags_at_their_edges(spark):
    got = values(spark, [(x,) for x in (None, 0.0, 0.3, 2.0, 5.0, 10.0, 20.0, 30.0)], "a double", metrics.duration_bucket(F.col("a")))
    assert [g[0] for g in got] == ["missing", "zero", "very_short", "short", "medium", "long", "very_long", "very_long"]
    got = values(spark, [(0.2, "x"), (0.5, "x"), (0.4999996, "x"), (0.1, ""), (None, "x")], "a double, p string", metrics.critical(F.col("a"), F.col("p")), metrics.critical(F.col("a"), F.col("p"), on_rounded=False), metrics.cer_bucket(F.col("a")))
    assert got == [(False, False, "medium"), (True, True, "hard"), (True, False, "medium"), (True, True, "easy"), (False, False, None)]


def test_digest_and_ids(spark):
    got = values(spark, [("a b/c",), ("",)], "a string", text.safe_id(F.col("a")), text.prompt_digest(F.col("a")), text.escape_cell(F.lit("a|b\\\n")))
    assert got[0][0] == "a_b__c" and len(got[0][1]) == 12 and got[1][1] == "" and got[0][2] == "a\\|b\\\\ "


def test_phonetic_key_marks_unknown_signs(spark):
    lexicon = F.create_map(F.lit("你"), F.lit("nei5"))
    assert values(spark, [("你x",)], "a string", text.phonetic_key(F.col("a"), lexicon)) == [("nei5 UNK:x",)]
    words = F.create_map(*[F.lit(x) for x in ("行", "hang4", "銀行", "ngan4 hong4", "你", "nei5")])
    got = values(spark, [("你銀行行",), ("銀",), ("",)], "a string", text.phonetic_key(F.col("a"), words, longest=3))
    assert got == [("nei5 ngan4 hong4 hang4",), ("UNK:銀",), ("",)]


def test_unsafe_numerals_and_partial_maps(spark):
    got = values(spark, [("廿十零",), ("二十",), ("x",)], "a string", text.unsafe_numerals(F.col("a")))
    assert got == [(True,), (False,), (False,)]
    assert values(spark, [("体汉",)], "a string", text.to_traditional(F.col("a"), without=text.LEAKAGE_UNMAPPED)) == [("体漢",)]


def test_dtw_of_a_sequence_with_itself_is_the_diagonal():
    x = np.random.default_rng(0).normal(size=(9, 4))
    path, cost = frames.dtw(x, x)
    assert path.tolist() == [[i, i] for i in range(9)] and cost == pytest.approx(0, abs=1e-9)


def test_dtw_agrees_with_a_plain_recursion():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(8, 3))
    cost = frames.cosine_cost(x, y)
    best = {}
    for i in range(6):
        for j in range(8):
            before = [best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best]
            best[i, j] = cost[i, j] + (min(before) if before else 0)
    path, per_step = frames.dtw(x, y)
    assert per_step * len(path) == pytest.approx(best[5, 7])


def test_alignment_fills_gaps():
    seq = np.arange(6.0).reshape(3, 2)
    out = frames.align(seq, np.array([[1, 0], [1, 1], [3, 2]]), 5)
    assert out.tolist() == [[0, 1], [1, 2], [1, 2], [4, 5], [4, 5]]


def test_interpolation_and_padding():
    assert frames.interpolate(np.array([[0.0], [1.0]]), 4).ravel().tolist() == [0, 0.25, 0.75, 1]
    batch, mask = frames.pad_and_mask([np.ones((2, 3)), np.ones((4, 3))])
    assert batch.shape == (2, 4, 3) and mask.sum(axis=1).tolist() == [2, 4]


def test_log_mel_of_a_tone_peaks_at_its_frequency():
    wave = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    mel = frames.log_mel(wave)
    centre = np.argmax(frames.mel_filters(16000, 400, 80, 20, 7600)[25])
    assert mel.shape == (51, 80) and abs(int(mel.mean(axis=0).argmax()) - centre) <= 1


def test_loudness_and_resampling():
    wave = np.sin(np.arange(1000) / 5) * 0.01
    assert 20 * np.log10(np.sqrt((frames.loudness(wave) ** 2).mean())) == pytest.approx(-23, abs=0.01)
    assert len(frames.resample(wave, 8000, 16000)) == 2000 and not frames.loudness(np.zeros(4)).any()


def test_masked_losses(spark):
    row = spark.createDataFrame([([1.0, 2.0, 9.0], [1.0, 4.0, 0.0], [True, True, False])], "x array<double>, y array<double>, m array<boolean>")
    got = row.select(frames.masked_l1(F.col("x"), F.col("y"), F.col("m")).alias("a"), frames.masked_smoothness(F.col("x"), F.col("m")).alias("b")).first()
    assert (got["a"], got["b"]) == (1.0, 1.0)

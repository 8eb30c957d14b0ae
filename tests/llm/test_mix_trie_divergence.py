"""Mixing, prefix trie and source divergence against brute force."""

import random
from collections import defaultdict

import pytest

from talus.llm import divergence, mixing, prefix_trie
from talus.llm.common import Scratch
from tests.llm import brute

DOCS = "doc_id long, text string, source string, lang string, size long, src string, key string, rank int, target double, p long, tile long"


def docs_table(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, s, lang, 7, "x", "k", 1, 0.5, 3, 4) for d, t, s, lang in rows], DOCS)


def mixed(spark, docs, **options):
    return [r.asDict() for r in mixing.mix_sources(docs_table(spark, [(d, t, s, "en") for d, t, s in docs]), **options).collect()]


def corpus(seed, n, sources):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a", "b", "c", "d"], ["hot"] * 8 + ["é", "Z", "", None], ["only"]])
def test_mixing_targets_and_budgets(spark, sources):
    docs = [*corpus(len(sources), 150, sources), (500, None, sources[0]), (501, "", None), (502, " a\tb\n c\x0b\x0cd ", "a"), (7, "again again", "a"), (7, "again again", "a"), (None, "x y", "a"), (None, "z", "a"), (503, "v " * 5000, "long")]
    want, got = brute.mix(docs), mixed(spark, docs)
    assert len(got) == len(docs)
    taken = defaultdict(int)
    for r in got:
        size, target = want[r["source"]]
        assert r["source_size"] == size and r["target"] == pytest.approx(target, abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        # all of a source's documents are taken as often, those that come first once more, and one in part
        assert r["repeats"] * r["size"] <= r["taken"] <= (r["repeats"] + 1) * r["size"]
        taken[r["source"]] += r["taken"]
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 0.5
    assert sorted((r["size"]) for r in got) == sorted(len((t or "").split()) for _, t, _ in docs)
    for s in want:  # at most one document of a source is cut
        cut = [r for r in got if r["source"] == s and r["size"] and r["taken"] % r["size"]]
        assert len(cut) <= 1


def test_mixing_is_repeatable_and_random(spark):
    docs = corpus(3, 200, ["a", "b"])
    first, again, other = (sorted(tuple(r.values()) for r in mixed(spark, docs[::step], seed=seed)) for step, seed in ((1, "mix"), (-1, "mix"), (1, "2")))
    assert first == again != other
    order = [r for r in mixed(spark, docs) if r["source"] == "a" and r["size"]]
    ids = [r["doc_id"] for r in sorted(order, key=lambda r: r["place"])]
    assert ids != sorted(ids)
    assert [r["place"] for r in sorted(order, key=lambda r: r["place"])][0] == 0


def test_mixing_by_joins_other_weights_and_empty_tables(spark):
    docs = corpus(4, 120, ["a", "b", "c"])
    plain, joined = (sorted(map(repr, mixed(spark, docs, **o))) for o in ({}, {"broadcast_limit": -1}))
    assert plain == joined
    got = mixed(spark, docs, weights=(0, 1))
    assert {r["taken"] for r in got if r["source"] in ("a", "c")} == {0} and sum(r["taken"] for r in got) > 0
    # shares above what all sources may give
    assert all(r["taken"] == 2 * r["size"] for r in mixed(spark, docs, epochs=2, share=5.0))
    assert mixed(spark, []) == []
    assert {r["taken"] for r in mixed(spark, [(1, None, None), (2, "", "a")])} == {0}


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "bot"]) if t > 3 else "user", rng.choice(["a", "b", "ää"]) if t > 1 else "hello"))
    rng.shuffle(rows)
    return rows


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "conv_id long, turn long, role string, text string, node long, path string, depth long")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).select(*cols).collect()), key=repr)


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 3])
def test_prefix_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    odd = [(900, None, "user", "x"), (900, None, "bot", "x"), (900, 0, None, None), (900, 0, None, None), (901, 5, "user", ""), (None, 1, "user", "lost"), (902, 1, "u", "ser"), (903, 1, "us", "er"), (1001, 0, "user", "no base"), (-3, 0, "user", "below"), (-5, 0, "user", "b"), (0, 0, "user", "zero"), (9223372036854775807, 1, "user", "last"), (-9223372036854775808, 1, "user", "first")]
    long_one = [(950 + i, t, "user", f"t{t}" if t < 30 + 9 * i else f"own{i}-{t}") for i in range(4) for t in range(70)]
    same = [(c, t, "user", "same" * t) for c in range(2000, 2040) for t in range(12)]
    rows = conversations(1, 60) + odd + long_one + same + [(2050, 0, "user", "é" * 50000)]
    assert trie(spark, rows) == sorted(brute.prefix_trie(rows), key=repr)


def test_prefix_trie_hot_parents_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 0.001)  # parents of over 1000 children more than nodes / HOT_PARENTS: none is broadcast
    rows = conversations(2, 40)
    assert trie(spark, rows) == sorted(brute.prefix_trie(rows), key=repr)
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 10**9)
    wide = [(c, 0, "user", f"{c % 1500}") for c in range(0, 7500, 5)]
    assert trie(spark, wide) == sorted(brute.prefix_trie(wide), key=repr)
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []


def test_peeling_rounds(spark):
    """A path hangs from the one before; totals pass from one to the next."""
    rows = [(i, i - 1 if i else None, 1, 10 + i) for i in range(6)] + [(9, 2, 1, 5)]
    scratch = Scratch(spark, "peel")
    got = {r["path"]: (r["n_leaves"], r["saved"]) for r in prefix_trie.peel(spark.createDataFrame(rows, "path long, parent_path long, n_leaves long, saved long"), scratch).collect()}
    want = {i: (6 - i + (i <= 2), sum(range(10 + i, 16)) + 5 * (i <= 2)) for i in range(6)} | {9: (1, 5)}
    assert got == want


def divergence_docs(seed, n, sources=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, s = rng.choice(["en", "fr", None]), rng.randrange(sources)
        words = ["the", "of", f"x{chr(97 + s)}", *(f"w{chr(97 + rng.randrange(20))}{chr(97 + rng.randrange(3) * s)}" for _ in range(rng.randrange(40)))]
        out.append((i, " ".join(rng.choice([w, w.upper()]) + rng.choice([",", "", "1"]) for w in words), f"s{s}" if s else None, lang))
    return out


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3, "TERMS": 4, "POSTINGS": 10}, {"LIGHT_GROUPS": 100}, {"LIGHT_GROUPS": 0, "BLOCK": 2}])
def test_source_divergence(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    docs = [*divergence_docs(5, 160), (1, None, "s1", "en"), (2, "", "empty", "en"), (3, "123 !?", "digits", "de"), (4, "rare", "other", "de"), (5, "é" * 9 + " Ébène ÉBÈNE " * 3, "s1", "fr"), (6, "the " * 4000, "s2", "en"), (6, "the " * 4000, "s2", "en")]
    got = sorted((tuple(r) for r in divergence.source_divergence(docs_table(spark, docs), top=9).collect()), key=repr)
    assert got == sorted(brute.divergence([d[1:2] + (d[3], d[2]) for d in docs], top=9), key=repr)


def test_source_divergence_by_joins_and_of_empty_tables(spark):
    docs = divergence_docs(6, 80)
    got = sorted((tuple(r) for r in divergence.source_divergence(docs_table(spark, docs), broadcast_limit=-1).collect()), key=repr)
    assert got == sorted(brute.divergence([d[1:2] + (d[3], d[2]) for d in docs]), key=repr)
    assert divergence.source_divergence(docs_table(spark, [])).collect() == []

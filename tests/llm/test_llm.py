"""Operators against brute force, exact round trips, and held-out accuracy on made-up texts."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import components, decontaminate, exact_dedup, licenses, line_dedup, minhash, packing, quality, toxicity, url_filter, warc
from talus.llm import queries as q
from talus.llm.common import Scratch
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LICENSE_TEXTS = Path(licenses.__file__).parent / "license_texts"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, kept boolean"


def table(spark, rows, extra=True):
    """Documents with columns whose names clash with inner ones."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", False) for d, t in rows], DOCS)


def sentence(rng, n, words="ab cd ef gh ij kl mn op qr st".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(1, 60)) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.6:
            w = t.split()
            w[rng.randrange(len(w))] = "zz" + str(i)
            t = " ".join(w)
        out.append((i, t.upper() if rng.random() < 0.2 else t))
    return [*out, (900, None), (901, ""), (902, "  \n "), (903, "one"), (904, "ONE"), (905, "Éa"), (906, "éa"), (907, "w " * 3000)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark):
    docs = corpus()
    for keep, best in (("min", min), ("max", max)):
        got = by_id(exact_dedup.exact_duplicates(table(spark, docs), keep=keep))
        groups = {}
        for d, t in docs:
            groups.setdefault(brute.ascii_lower(t), []).append(d)
        for d, t in docs:
            g = groups[brute.ascii_lower(t)]
            assert tuple(got[d]) == (d, best(g), len(g), d == best(g), hashlib.sha256(brute.ascii_lower(t).encode()).hexdigest())


def test_exact_dedup_tells_colliding_hashes_apart(spark):
    docs = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")]
    weak = lambda c: F.length(F.col(c)).cast("string")
    got = by_id(exact_dedup.exact_duplicates(table(spark, docs), digest=weak))
    assert {d: r["keep_id"] for d, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_duplicates(table(spark, [(None, "a"), (None, "b"), (5, "b"), (5, "b")])).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == [(5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (None, None, 1, True)]
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_line_dedup(spark, limit):
    rng = random.Random(2)
    lines = [sentence(rng, n) for n in (1, 2, 3, 5, 8, 13, 4, 4)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    docs += [(50, docs[3][1]), (51, None), (52, ""), (53, " \n\t"), (54, "\n".join([lines[0]] * 30)), (55, "\n  \n".join(f" {x}\t" for x in lines[:6]))]
    for min_words in (1, 7, 12):
        wanted = brute.line_dedup(docs, min_words)
        got = by_id(line_dedup.line_dedup(table(spark, docs), min_words=min_words, broadcast_limit=limit))
        assert {d: (r["n_lines"], r["n_removed"], r["text"]) for d, r in got.items()} == wanted
        if limit == 0:
            break


def test_suffix_array_and_common_prefixes(spark):
    """Ranks follow the order of suffixes, and neighbours have as many lines in common as their lists of lines show."""
    rng = random.Random(5)
    texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    texts += [texts[0], [2] * 11]
    rows = [(t, 0, p, line) for t, lines in enumerate(texts) for p, line in enumerate(lines)]
    for longest in (1, 3, 6):
        scratch = line_dedup.Scratch(spark, "test")
        given = spark.createDataFrame(rows, "text_key long, stretch long, pos long, line long")
        ranked = line_dedup.suffix_ranks(given, longest, scratch, 1 << 20).collect()
        head = {r["rank"]: tuple(texts[r["text_key"]][r["pos"] : r["pos"] + longest]) for r in ranked}
        assert all(tuple(texts[r["text_key"]][r["pos"] : r["pos"] + longest]) == head[r["rank"]] for r in ranked)
        in_order = [head[r] for r in sorted(head)]
        assert in_order == sorted(in_order) and len(ranked) == len(rows)
        classes = spark.createDataFrame([(r, list(h)) for r, h in head.items()], "rank long, ids array<long>")
        got = {r["rank"]: r["lcp"] for r in line_dedup.common_prefixes(classes, scratch).collect()}
        before = ()
        for rank in sorted(head):
            same = [x == y for x, y in zip(before, head[rank], strict=False)]
            assert got[rank] == (same.index(False) if False in same else len(same))
            before = head[rank]


def test_line_dedup_keeps_lines_to_the_byte(spark):
    rng = random.Random(4)
    run = "\n".join(f"    {sentence(rng, 9)}  " for _ in range(3))
    docs = [(1, run), (2, f"\n  def f():\r\n\n        return 1\t\n{run}\n\n\tlast\n"), (None, f"head\n\n{run.replace(chr(10), chr(10) * 2)}\n \n"), (4, run.upper())]
    docs += [(5, "\n".join([f"line {i} " + "w " * 8 for i in range(3000)] + [run])), (6, "x " * 60_000), (7, "x " * 60_000)]
    got = by_id(line_dedup.line_dedup(table(spark, docs), min_words=20))
    assert got[2]["text"] == "\n  def f():\r\n\n        return 1\t\n\n\tlast\n" and got[None]["text"] == "head\n\n \n"
    assert (got[1]["n_removed"], got[4]["n_removed"], got[5]["n_removed"], got[6]["n_removed"], got[7]["text"]) == (0, 0, 3, 0, "")
    assert len(got[5]["text"].split("\n")) == 3000


def test_line_dedup_keeps_columns_and_handles_empty_tables(spark):
    out = line_dedup.delete_repeated_lines(table(spark, [(1, "a b"), (None, "a b"), (1, "a b")]), min_words=2)
    assert out.columns[:7] == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r["text"], r["__n_removed"]) for r in out.collect()) == [("", 1), ("a b", 0), ("a b", 0)]
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80), (1, 80), (1, 50), (2, 100)])
def test_near_duplicates(spark, words, percent):
    docs = corpus(seed=words)
    got = by_id(minhash.near_duplicates(table(spark, docs), words=words, percent=percent))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute.near_duplicates(docs, words, percent)


def test_near_duplicates_edges(spark):
    got = minhash.near_duplicates(table(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (None, None)])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == [(7, 7, True), (7, 7, True), (8, 8, True), (None, 7, False), (None, None, True)]
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    """Copies of one text with edits of every rate: most pairs are just above or below the threshold."""
    rng, base = random.Random(3), [f"w{i}" for i in range(80)]
    docs = []
    for i in range(260):
        w = list(base)
        for k in rng.sample(range(80), i % 9):
            w[k] = rng.choice((f"x{rng.randrange(60)}", f"y{i}", ""))
        docs.append((i, " ".join(w)))
    got = by_id(minhash.near_duplicates(table(spark, docs), words=3, percent=85))
    wanted = brute.near_duplicates(docs, 3, 85)
    assert {d: tuple(r)[1:] for d, r in got.items()} == wanted and 20 < len({r[1] for r in wanted.values()}) < 200


def test_estimate_is_close_to_the_similarity(spark):
    rng, signer, rows = np.random.default_rng(1), minhash.Signer(*minhash.band_shape(85)), []
    for share in (0.0, 0.3, 0.6, 0.85, 1.0):
        for _ in range(40):
            same, rest = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64), lambda s=share: rng.integers(0, 1 << 63, int(400 * (1 - s) / 2), dtype=np.uint64)
            x, y = (signer.planes(signer.minima(np.concatenate([same, rest()]))) for _ in range(2))
            rows.append((share, *x, *y))
    names = [f"{s}{p}" for s in "xy" for p in minhash.PLANES]
    df = spark.createDataFrame(rows, "share double, " + ", ".join(f"{n} long" for n in names))
    df = df.select("share", *[F.struct(*[F.col(f"{s}{p}").alias(p) for p in minhash.PLANES]).alias(s) for s in "xy"])
    means = {r["share"]: r["m"] for r in df.groupBy("share").agg(F.avg(minhash.estimate("x", "y")).alias("m")).collect()}
    assert all(abs(m - s) < 0.03 for s, m in means.items())


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_contamination(spark, limit):
    rng = random.Random(4)
    items = [(i, sentence(rng, n)) for i, n in enumerate((4, 10, 14, 30, 1))] + [(10, None), (11, "..."), (12, "Ä " * 12), (3, sentence(rng, 11))]
    docs = [(i, sentence(rng, 30)) for i in range(40)]
    docs += [(20 + i, f"x {items[i][1].upper()}! {sentence(rng, 5)} {items[1][1]}") for i in range(4)] + [(30, None), (31, ""), (32, "ä " * 40), (33, "Ä " * 40), (34, items[2][1][:40]), (35, items[0][1])]
    got = by_id(decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_limit=limit))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute.contamination(docs, items)


def test_contamination_of_very_long_texts_and_shared_passages(spark):
    rng, passage = random.Random(6), sentence(random.Random(1), 40)
    items = [(1, passage), (2, sentence(rng, 12) + " " + passage), (3, "aa " * 25), (None, sentence(rng, 11))]
    docs = [(i, f"{sentence(rng, 5)} {passage} {passage} {items[-1][1]}") for i in range(30)]
    docs += [(50, " ".join([sentence(rng, 20_000), passage, sentence(rng, 20_000), items[1][1]])), (51, "aa " * 30_000)]
    got = by_id(decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    wanted = brute.contamination(docs, items[:3])
    hit = brute.contamination(docs, items)
    assert {d: (r["n_words"], r["n_hit"], r["contaminated"]) for d, r in got.items()} == {d: (r[0], r[1], r[4]) for d, r in hit.items()}
    assert {d: (r["n_items"], r["items_sha256"]) for d, r in got.items()} == {d: r[2:4] for d, r in wanted.items()}


def test_near_duplicates_of_hot_groups(spark, monkeypatch):
    """Groups whose nodes have more pairs, edges and rows than one task is to take."""
    monkeypatch.setattr(minhash, "SPREAD", 7)
    monkeypatch.setattr(minhash, "HUB", 9)
    monkeypatch.setattr(components, "HUB", 11)
    rng = random.Random(9)
    base = sentence(rng, 80).split()
    docs = [(i, " ".join([*base[:40], f"x{i}", *base[41:]])) for i in range(150)] + [(200 + i, " ".join(base)) for i in range(60)] + [(300 + i, None) for i in range(30)] + [(400 + i, sentence(rng, 30)) for i in range(20)]
    rng.shuffle(docs)
    got = by_id(minhash.near_duplicates(table(spark, docs), words=3, percent=85))
    assert {d: tuple(r)[1:] for d, r in got.items()} == brute.near_duplicates(docs, 3, 85)


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(59, 100), (500, 501), (501, 500), (7, 7)]
    rng = random.Random(2)
    name = dict(zip(range(600), rng.sample(range(600), 600), strict=True))
    edges = [(name[a], name[b]) for a, b in links]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "star")).collect()}
    nodes = {n for e in edges for n in e}
    assert got == {n: c for n, c in brute.components(edges, nodes).items()}


def test_contamination_edges_and_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = table(spark, [(None, "red green blue"), (1, "red green blue"), (1, "red green blue"), (2, "blue x red y green"), (3, "red " + "x " * 50 + "green blue")])
    index = decontaminate.BenchmarkIndex(docs, items, window=10)
    assert sorted(((r["doc_id"], r["n_hit"]) for r in index.report().collect()), key=repr) == [(1, 3), (1, 3), (2, 0), (3, 0), (None, 3)]
    near = {(r["first"], r["last"]) for r in index.proximity_matches(slop=10).collect()}
    assert near == {(0, 2), (0, 4)}
    assert {(r["pos"], r["length"]) for r in index.phrase_matches().collect()} == {(0, 3)}
    assert decontaminate.contamination(table(spark, []), items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count()


def test_proximity_against_all_places(spark):
    rng = random.Random(12)
    vocabulary = [a + b for a in "abcd" for b in "xyz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 4, 5, 8, 2))]
    docs = [(i, " ".join(rng.choice([*vocabulary, "other", "words"]) for _ in range(60))) for i in range(12)] + [(20, None), (21, items[0][1]), (21, items[0][1])]
    want = set()
    for d, text in docs:
        words = (text or "").split()
        for item, phrase in items:
            w, spans = phrase.split(), {}
            for start in range(max(len(w) - 4, 0) + 1):
                terms = set(w[start : start + 4])
                for at, word in enumerate(words):
                    inside = [k for k in range(at, min(at + 9, len(words))) if words[k] in terms]
                    if word in terms and {words[k] for k in inside} == terms:
                        spans.setdefault(start, []).append((at, inside[-1]))
            if spans:
                want.add((d, str(item), len(spans), min(a for s in spans.values() for a, _ in s), max(z for s in spans.values() for _, z in s)))
    index = decontaminate.BenchmarkIndex(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=4)
    got = [tuple(r) for r in index.proximity_report(slop=9).collect()]
    assert set(got) == want and len(want) > 20 and len(got) == len(want) + len([w for w in want if w[0] == 21])


def test_proximity_spans_are_whole(spark):
    """One row for each place that a span begins at, with the span's last word; bins of places cut none."""
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    for shift in range(6):
        docs = table(spark, [(1, "x " * shift + "red green blue green")])
        got = {(r["first"], r["last"]) for r in decontaminate.BenchmarkIndex(docs, items).proximity_matches(slop=5).collect()}
        assert got == {(shift, shift + 3)}


def test_proximity_shuffles_no_more_than_the_lists(spark):
    """Each window has a rare word among frequent ones, in texts that have all of them: what is shuffled must not grow with windows times words."""
    rng = random.Random(5)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(40)]
    items = [(i, " ".join([*(rng.choice(common) for _ in range(9)), rare[i], *(rng.choice(common) for _ in range(9))])) for i in range(40)]
    docs = [(i, " ".join(rng.choice(common) for _ in range(300)) + " " + rare[i % 40]) for i in range(80)]
    index = decontaminate.BenchmarkIndex(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(after=-1):
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        found = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(i) for i in range(stages.size()))]
        return max(k for k, _ in found), sum(n for k, n in found if k > after)

    last, _ = shuffled()
    assert index.proximity_report(slop=20).count() > 0
    n = shuffled(last)[1]
    assert n < 4 * index.postings.count()


def test_licences(spark):
    mit = dict(licenses.LICENSES)["MIT"]
    docs = [(1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.replace('"', "“").upper().replace("\n\n", "\n")), (3, mit + " more"), (4, None), (5, ""), (6, "a\nReleased under the MIT  licence!\nLicensed under CC BY 4.0"), (7, "Copyright 2020 X\n"), (7, "Copyright 2020 X\n")]
    docs += [(8, "plain text"), (8, mit), (None, docs[5][1]), (None, docs[5][1]), (9, "\n" * 50_000 + "Released under the MIT license")]
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notice_lines"]) for r in licenses.scan_licenses(table(spark, [r for r in docs if r[0] != 8])).collect()}
    assert got.pop(9) == ("MIT", "MIT", 1) and got.pop(None) == (None, "CC-BY-4.0,MIT", 2)
    assert got == {1: ("MIT", None, 0), 2: ("MIT", None, 0), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, 0), 6: (None, "CC-BY-4.0,MIT", 2), 7: (None, None, 0)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    mine = licenses.scan_licenses(table(spark, docs)).collect()
    assert len(mine) == len(docs) and sorted(r["license_id"] or "" for r in mine if r["doc_id"] == 8) == ["", "MIT"]
    assert sorted(map(tuple, mine), key=repr) == sorted(con.execute(licenses.license_sql()).fetchall(), key=repr)
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_licences_of_usual_files(spark):
    mit, zlib_text = dict(licenses.LICENSES)["MIT"], dict(licenses.LICENSES)["Zlib"]
    bsd = (LICENSE_TEXTS / "BSD-3-Clause.txt").read_text()
    two = (LICENSE_TEXTS / "BSD-2-Clause.txt").read_text()
    apache, gpl = (LICENSE_TEXTS / "Apache-2.0.txt").read_text(), (LICENSE_TEXTS / "GPL-3.0.txt").read_text()
    docs = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), (2, "The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + mit), (3, "zlib License\n\n(C) 2020 X\n\n" + zlib_text),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd), (5, "Copyright (c) 2020, X\n\n" + two.replace("1. ", "* ").replace("2. ", "* ")),
        (6, apache.replace("[yyyy] [name of copyright owner]", "2020 X")), (7, gpl.replace("https:", "http:")), (8, apache[: apache.index("END OF TERMS")]), (9, gpl + " more"), (10, "MIT License"),
    ]
    found = licenses.scan_licenses(table(spark, docs)).collect()
    got = {r["doc_id"]: r["license_id"] for r in found}
    assert got == {1: "MIT", 2: "MIT", 3: "Zlib", 4: "BSD-3-Clause", 5: "BSD-2-Clause", 6: "Apache-2.0", 7: "GPL-3.0", 8: "Apache-2.0", 9: None, 10: None}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(map(tuple, found), key=repr) == sorted(con.execute(licenses.license_sql()).fetchall(), key=repr)


def make_labelled(n=400, seed=9):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.randrange(5, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "grobian" + rng.choice("abcdefghijkl") + rng.choice("mnopq"))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 > 0), int(bad)))
    return docs, labels


def test_toxicity_finds_unseen_spellings(spark):
    docs, labels = make_labelled()
    rows = table(spark, [*docs, (None, "grobianzz"), (5000, None), (5001, "…")])
    got = toxicity.score_toxicity(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    truth = {d: t for d, _, t in labels}
    assert {r["doc_id"] for r in held} >= {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    right = sum(r["predicted"] == truth.get(r["doc_id"], 0) for r in held) / len(held)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows.collect())
    none = toxicity.score_toxicity(rows, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] < 1e-3 for r in none.collect()} == {True}
    assert toxicity.score_toxicity(table(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_worst_window_starts_at_every_word():
    model = toxicity.SubwordBag(np.zeros(1, np.float32), 1.0, 0.0)
    for before in range(9):
        values = np.array([0.0] * before + [5.0, 0.0, 0.0, 5.0] + [0.0] * 9)
        assert model.worst(values) == 10 / model.window
    assert model.worst(np.array([5.0])) == 5.0 and model.worst(np.array([])) == 0.0


def test_quality_sees_the_whole_text(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(300):
        t = sentence(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            t = " ".join(w + rng.choice(("%%%", "###", "$$$")) for w in t.split())
        docs.append((i, t))
        labels.append((i, int(i % 3 > 0)))
    rows = table(spark, [*docs, (5000, None), (None, "x")])
    got = quality.score_quality(rows, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95 and len(got) == 302
    net = quality.train_byte_conv_net([t for _, t in docs], [y for _, y in labels], {0: 100, 1: 200}, epochs=4)
    long = "abcd " * 100_000
    assert net.scores([long])[0] == pytest.approx(net.scores([long, "x"])[0]) and net.scores([long + "%%% ### " * 50])[0] != net.scores([long])[0]


def test_convolution_against_loops():
    """Scores of a network with random weights, against filters laid on every byte one by one."""
    rng = np.random.default_rng(5)
    width, block, chunk, step = quality.WIDTH, quality.BLOCK, quality.CHUNK, quality.STEP
    net = quality.ByteConvNet(rng.normal(0, 1, (width, 256, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32), rng.normal(0, 1, 3), rng.normal(0, 1, 3), 0.3)
    texts = ["", "a", "xyz" * 40, "é" * 500, "q" * block, "q" * (block - 1), "end" * 333, "words and more " * 70]
    for text, got in zip(texts, net.scores(texts), strict=True):
        raw = text.encode() or b"\0"
        at = [net.bias + sum(net.table[k, (raw + bytes(width))[i + k]] for k in range(width)) for i in range(len(raw))]
        blocks = [np.max(at[s : s + block], axis=0) for s in range(0, len(at), block)]
        starts = range(0, max(len(blocks) - chunk, 0) + step, step) if len(blocks) > chunk else [0]
        pooled = np.maximum([np.max(blocks[s : s + chunk], axis=0) for s in starts if s < len(blocks)], 0)
        z = (pooled.mean(axis=0) * net.mean).sum() + (pooled.max(axis=0) * net.most).sum() + net.shift
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-5)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, ("good words here " if i % 2 else "### %%% ") * 9) for i in range(40)]
    assert quality.score_quality(table(spark, []), labels).count() == 0
    got = quality.score_quality(table(spark, [*rows, rows[3], (None, None), (77, "good " * 100_000)]), labels).collect()
    assert len(got) == 43 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_word_logits_against_loops():
    """A word's logit is the average over itself and its marked n-grams, each found anew."""
    rng = np.random.default_rng(2)
    model = toxicity.SubwordBag(rng.normal(0, 1, 1 << 10).astype(np.float32), 1.0, 0.0)
    for word in ("a", "ab", "grün", "misspelled", "日本語"):
        buckets, owner = toxicity.subwords([word], model.bits, model.lengths)
        marked = f"<{word}>"
        assert len(buckets) == 1 + sum(max(len(marked) - n + 1, 0) for n in model.lengths) and set(owner) == {0}
        assert model.word_logits(["x", word, "yy"])[1] == pytest.approx(np.mean([model.weight[b] for b in buckets]))
    one, two = (set(toxicity.subwords([w], model.bits, model.lengths)[0].tolist()) for w in ("idiotic", "xidiotic"))
    assert len(one & two) >= 9  # n-grams inside are shared, whatever their place


def test_toxicity_scores_against_loops():
    """A text's score from the logits of its words, window by window and over all of it."""
    rng = np.random.default_rng(8)
    model = toxicity.SubwordBag(rng.normal(0, 1, 1 << 10).astype(np.float32), 1.3, -0.4, 0.7)
    words = ["some", "words", "grün", "a", "misspelled", "日本語", "x1"]
    texts = ["", "...", "some", "Some words", " ".join(words), ", ".join(words * 30).upper(), "a " * 5000]
    for text, got in zip(texts, model.scorer()(texts), strict=True):
        split = re.findall(r"\w+", text.lower())
        logits = [float(model.word_logits([w])[0]) for w in split]
        windows = [np.mean(logits[i : i + 4]) for i in range(max(len(logits) - 3, 1))] if logits else [0.0]
        z = 1.3 * max(windows) + 0.7 * (np.mean(logits) if logits else 0.0) - 0.4
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_urls_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "http://a.com/fr/x"), (1, "http://a.com/fr/x"), (None, "http://a.com/de/"), (None, None), (2, "http://b.org/" + "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for limit in (16 << 20, 0):
        got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, q.URL_RULES, broadcast_limit=limit).collect()), key=repr)
        assert got == sorted([(1, "com/fr/", "allow"), (1, "com/fr/", "allow"), (None, "com/de/", "block"), (None, None, "allow"), (2, "org/", "allow")], key=repr)


def test_line_dedup_beside_columns_of_inner_names(spark):
    run = "\n".join(f"line {i} of a run that repeats" for i in range(9))
    names = ["__id", "__seen", "__key", "__raw", "__at", "__gone", "text_key", "spans", "___key", "__n_lines"]
    rows = [(i, f"own {i}\n{run}\nend {i}", *[f"{n}{i}" for n in names]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = by_id(line_dedup.delete_repeated_lines(df, min_words=20))
    assert all(got[i][n] == f"{n}{i}" for i in range(4) for n in names[:-1])
    assert got[0]["text"] == rows[0][1] and [got[i]["text"] for i in (1, 2, 3)] == [f"own {i}\nend {i}" for i in (1, 2, 3)]
    assert [got[i]["__n_lines"] for i in range(4)] == [11] * 4


def test_token_bytes_equal_the_tokenizer():
    pytest.importorskip("public_tokenizers")
    encoder = packing.TokenBytes(q.tokenizer_path())
    rng = random.Random(0)
    parts = ["Hello", " world", "'s", "'ll", "  ", "\n", " \n", "\t", "é", "ß", "123", " 4", "!?", "日本", "<|endoftext|>", "\x1c", "\x85", "\u00a0", "a", "²", "ª", "_"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()
    slow = packing.TokenBytes(q.tokenizer_path())
    slow.encode_piece = slow._encode
    assert slow.encode("Some words, ünd 12") == encoder.encode("Some words, ünd 12")


def first_fit(demand, capacity):
    left, used = dict(demand), 0
    while any(left.values()):
        room, filling = capacity, {}
        for s in sorted(left, reverse=True):
            if left[s] and s <= room:
                filling[s] = min(left[s], room // s)
                room -= filling[s] * s
        times = min(left[s] // n for s, n in filling.items())
        used += times
        for s, n in filling.items():
            left[s] -= times * n
    return used


def packed(demand, capacity):
    patterns, made = packing.pack_lengths(demand, capacity), {}
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for s in pattern:
            made[s] = made.get(s, 0) + times
    assert made == {s: n for s, n in demand.items() if n}
    return sum(t for _, t in patterns)


def test_cutting_stock_meets_the_demand_near_the_bound():
    rng = random.Random(3)
    demand = {s: rng.randrange(1, 400) for s in rng.sample(range(1, 34), 25)}  # small enough for the bound to be met
    assert packed(demand, 64) <= -(-sum(s * n for s, n in demand.items()) // 64) + 1
    assert packing.pack_lengths({}, 64) == [] and packing.pack_lengths({5: 0}, 64) == []
    assert packed({64: 3, 1: 1}, 64) == 4
    many = {s: rng.randrange(1, 9) for s in range(1, 2049)}  # as many lengths as there are
    assert packed(many, 2048) <= first_fit(many, 2048) * 1.001 + 1


def test_cutting_stock_where_lengths_hardly_fit():
    """Lengths of which first fit makes bad sequences: three of the smallest miss one token, pairs of the middle ones fit with the largest."""
    hard = {1025: 2000, 1000: 2010, 683: 4000, 650: 3000, 500: 1500, 342: 1500}
    assert packed(hard, 2048) < first_fit(hard, 2048)
    trap = {1200: 3000, 848: 1500, 424: 6000, 1000: 3000, 524: 6000}
    assert packed(trap, 2048) <= first_fit(trap, 2048)
    prices, basis = packing.solve_linear_program(trap, 2048)
    assert all(sum(prices[s] * n for s, n in pattern.items()) <= 1 + 1e-3 for pattern, _ in basis)
    bound = sum(prices[s] * n for s, n in trap.items())
    assert packed(trap, 2048) <= bound + len(trap)  # rounding costs at most a sequence a length


def test_cutting_stock_is_always_solved(monkeypatch):
    """Also where prices in proportion to length would do: the patterns come from the prices of the program's simplex."""
    solved, solve = [], packing.solve_linear_program
    monkeypatch.setattr(packing, "solve_linear_program", lambda demand, capacity, *a, **b: solved.append(sum(demand.values())) or solve(demand, capacity, *a, **b))
    rng = random.Random(8)
    for lengths in (60, 300, 900):  # exact lengths, and classes of them
        demand = {s: rng.randrange(1, 40) for s in rng.sample(range(1, 1024), lengths)}
        assert packed(demand, 2048) <= -(-sum(s * n for s, n in demand.items()) // 2048) * 1.001 + 1
        assert solved == [sum(demand.values())]
        solved.clear()


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    docs = [*corpus(), (907, "again"), (None, "no id")]
    got = packing.pack_documents(table(spark, docs), q.tokenizer_path()).collect()
    encoder, sequences, pieces = packing.TokenBytes(q.tokenizer_path()), {}, {}
    wanted = sorted(len(encoder.encode(t or "")) // 4 + 1 for _, t in docs)
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in got) == sum(wanted)
    texts = dict(docs[:-2])
    for d in (3, 900, 907):
        raw = encoder.encode({**texts, 907: "w " * 3000}[d] or "") + np.array([1], "<u4").tobytes()
        for r in pieces[d, len(raw) // 4]:
            assert zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    assert packing.pack_documents(table(spark, []), q.tokenizer_path()).count() == 0


def test_packing_against_the_tokenizer(spark):
    """Every piece of every document against ids that the tokenizer itself gives; ids are texts here."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(q.tokenizer_path())
    rng = random.Random(11)
    parts = ["Hello", " world", "'s", "  ", "\n\n", "\t", "é", "ß", "123", "!?", "日本語", "🙂", "<|endoftext|>", " Wörter", "\u00a0", "_", "x" * 40]
    docs = [(f"a{i}", "".join(rng.choice(parts) for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [("z", None), ("a0", "again"), (None, "no id"), ("long", "many words " * 9000)]
    rows = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id string, text string, start int")
    got = packing.pack_documents(rows, q.tokenizer_path()).collect()
    wanted = []
    for d, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append((d or "", len(ids), zlib.crc32(ids.tobytes())))
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d and r["doc_tokens"] == len(ids))
        assert any(all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine[k : k + -(-len(ids) // 2048)]) for k in range(len(mine)))
    assert sum(r["length"] for r in got) == sum(n for _, n, _ in wanted)


def test_packing_pads_short_texts_little(spark):
    pytest.importorskip("public_tokenizers")
    rng, encoder = random.Random(2), packing.TokenBytes(q.tokenizer_path())
    docs = [(i, rng.choice((None, "a b c d e f g h", sentence(rng, 8))) if i % 3 == 0 else sentence(rng, rng.randrange(20, 500))) for i in range(900)]
    for rows in (docs, [(i, None) for i in range(2000)], [(i, "a b c d e f g h") for i in range(2000)]):
        total = sum(len(encoder.encode(t or "")) // 4 + 1 for _, t in rows)
        got = packing.pack_documents(table(spark, rows), q.tokenizer_path()).collect()
        assert sum(r["length"] for r in got) == total
        assert len({r["sequence_id"] for r in got}) <= -(-total // 2048) * 1.01 + 1


def test_urls(spark):
    rules = [*q.URL_RULES, url_filter.Rule("block", "b.example.com", ""), url_filter.Rule("allow", "b.example.com", "/x/y"), url_filter.Rule("allow", "dup.net"), url_filter.Rule("block", "dup.net")]
    urls = ["https://A.example.ORG/es/1?q", "http://example.org/en/12", "http://x.org", "http://x.org/", "http://b.example.com", "http://b.example.com/x/yz", "http://b.example.com/x/", "http://c.com/de/", "http://example.com/fr/a#b", "nothing", None, "http://notexample.org/es/", "http://dup.net/", "http://x.org:80/a", "a://b.dup.net/é?x://y"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    wide = url_filter.filter_urls(pages, rules)
    joined = url_filter.filter_urls(pages, rules, broadcast_limit=0)

    def plain(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
        return (best.text, best.verdict) if best else (None, "allow")

    got = sorted(map(tuple, wide.collect()))
    assert got == sorted(map(tuple, joined.collect()), key=lambda r: r[0]) and all((r[3], r[4]) == plain(r[1], r[2]) for r in got)
    assert got[0][1:3] == ("a.example.org", "/es/1") and got[10][1:] == ("", "", None, "allow")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    html = ["<p>" + "é" * 60, "short", None, "<p>" + "é" * 60, "short", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://x 0 20200101000000 a/b 9\n" * 3]
    pages = spark.createDataFrame([(i, "http://a b/é\n" if i else None, h, "x") for i, h in enumerate(html)] + [(None, "u", html[0], "x"), (0, "u", html[0], "x")], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages, version=version).collect()
    assert len(got) == 8
    for i, h in enumerate(html[1:], 1):
        r = next(r for r in got if r["page_id"] == i)
        body = (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 0) if i == 3 else ("response", None))
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 0) == [("response", None), ("revisit", 0)]
    assert next(r for r in got if r["page_id"] is None)["refers_to"] == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_of_text_ids_and_large_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3 << 20)  # a file for each page or two
    rows = [("b/1 é", "u", "x" * 2_000_000), ("a\r\n", "u", "x" * 2_000_000), ("c", None, "small"), ("c", None, "small")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        [("a\r\n", 2_000_000, "response", None), ("b/1 é", 2_000_000, "revisit", "a\r\n"), ("c", 5, "response", None), ("c", 5, "response", None)]
    )


def test_every_archive_begins_with_a_version_block(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 20) for i in range(23)], "page_id long, url string, html string").coalesce(1)
    for per_file, files in ((10, 3), (1, 23), (30, 1)):
        path = f"{tmp_path}/{per_file}"
        warc.write_arc(pages, path, per_file=per_file)
        parts = sorted(Path(path).glob("part-*"))
        assert len(parts) == files
        names = set()
        for part in parts:
            kinds = [(r.warc_type, r.url) for r in warc.read_arc(part.read_bytes())]
            assert [k for k, _ in kinds].count("warcinfo") == 1 and kinds[0][0] == "warcinfo" and len(kinds) > 1
            names.add(kinds[0][1])
        assert len(names) == files
    warc.write_arc(pages.limit(0), f"{tmp_path}/none")
    assert [r.warc_type for p in Path(f"{tmp_path}/none").glob("part-*") for r in warc.read_arc(p.read_bytes())] in ([], ["warcinfo"])


def test_arc_reader_handles_damage():
    good = warc.arc_version_block(2, "n", "20200101") + b"\n" + warc.arc_header(2, "http://u/", "1.2.3.4", "20200102030405", "text/html", 5) + b"HELLO\n" + b"garbage line\n" + warc.arc_header(2, "dns:u", "1.2.3.4", "20200102", "text/dns", 50) + b"cut"
    got = list(warc.read_arc(good))
    assert [(r.warc_type, r.block, r.truncated) for r in got[1:]] == [("resource", b"HELLO", False), ("resource", b"cut", True)]
    assert got[1].warc_date == "2020-01-02T03:04:05Z" and got[2].warc_date == "2020-01-02T00:00:00Z" and got[0].warc_type == "warcinfo"
    assert got[1].record_id("a") == list(warc.read_arc(good))[1].record_id("a") != got[1].record_id("b")

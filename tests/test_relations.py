"""Logs, rewrites, rules, alignment, batches, readings and digests on small tables, against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import frames, metrics, readings, text
from talus.operators import alignment, audit, batches, compare, components, digests, features, manifest, summary
from talus.sources import staged, tables
from talus.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("attempt", range(4))
def test_later_appends_win_whatever_their_files_are_called(spark, tmp_path, attempt):
    path, schema = str(tmp_path / "log"), "k string, v int"
    numbers = [tables.append_jsonl(spark.createDataFrame([("a", v), (f"only{v}", v)], schema).repartition(3), path) for v in range(3)]
    assert numbers == [0, 1, 2]
    assert rows(tables.read_jsonl_cache(spark, path, schema, "k")) == [("a", 2), ("only0", 0), ("only1", 1), ("only2", 2)]


def test_log_order_inside_a_run_and_failed_runs(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k string, v int"
    many = spark.range(500, numPartitions=1).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("v")).repartitionByRange(12, "v").sortWithinPartitions("v")
    tables.append_jsonl(many, path)
    assert rows(tables.read_jsonl_cache(spark, path, schema, "k")) == [("a", 499)]
    broken = many.withColumn("v", F.when(F.col("v") < 490, F.col("v")).otherwise(F.raise_error("lost").cast("int")))
    with pytest.raises(Exception, match="lost"):
        tables.append_jsonl(broken, path)
    assert rows(tables.read_jsonl_cache(spark, path, schema, "k")) == [("a", 499)]
    assert tables.append_jsonl(many.filter("v = 7"), path) == 2 and tables.log_runs(spark, path) == [0, 2]
    assert rows(tables.read_jsonl_cache(spark, path, schema, "k")) == [("a", 7)]


def test_a_log_file_is_read_in_blocks_in_its_order(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text("".join(json.dumps({"k": f"k{i % 50}", "v": i}) + "\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sorted(r["v"] for r in tables.read_jsonl_cache(spark, str(path), "k string, v int", "k").collect()) == list(range(3950, 4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rewrites_replace_whole_versions(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "id int, text string, bad int"
    lines = spark.createDataFrame([(b'{"id": 1, "text": "a\xffb"}',), (b'{"id": 2, "text": "c"}',)], "value binary").select(F.col("value").cast("string").alias("value"))
    assert staged.publish_lines(lines, path) == 0
    assert rows(staged.current(spark, path, schema)) == [(1, "a�b", None), (2, "c", None)]
    score = lambda df: df.withColumn("bad", F.col("text").contains("�").cast("int"))
    assert staged.rewrite(spark, path, schema, score) == 1
    wanted = [(1, "a�b", 1), (2, "c", 0)]
    assert rows(staged.current(spark, path, schema)) == wanted
    with pytest.raises(Exception, match="broken"):
        staged.rewrite(spark, path, schema, lambda df: df.withColumn("bad", F.raise_error("broken").cast("int")))
    assert rows(staged.current(spark, path, schema)) == wanted and staged.versions(spark, path) == [0, 1]
    for _ in range(3):
        staged.rewrite(spark, path, schema, score, keep=2)
    assert staged.versions(spark, path) == [3, 4] and rows(staged.current(spark, path, schema)) == wanted
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("version")) == ["version=000003", "version=000004"]
    with pytest.raises(FileNotFoundError):
        staged.current(spark, str(tmp_path / "none"), schema)


def test_means_count_infinite_and_very_large_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", inf), ("a", nan), ("b", 1e27), ("b", None), ("b", 1e27), ("c", 0.1), ("c", 0.2), ("d", nan), ("e", -inf), ("e", inf)], "g string, v double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(summary.plain_mean("v").alias("m")).collect()}
    assert got["a"] == inf and got["b"] == 1e27 and got["c"] == pytest.approx(0.15) and got["d"] is None and np.isnan(got["e"])


def digest(values, sep=","):
    return hashlib.sha256(sep.join(values).encode()).hexdigest()


def test_digests_and_texts_in_order(spark):
    rng = random.Random(1)
    data = [(g, k, rng.choice(["é", "b" * 3000, "", "c"])) for g in "abc" for k in rng.sample(range(1000), 40)] + [("d", 1, None), ("e", 1, "")]
    df = spark.createDataFrame(data, "g string, k int, v string").repartition(5)
    lists = {g: [v for _, v in sorted((k, v) for h, k, v in data if h == g and v is not None)] for g in "abce"}
    assert dict(rows(digests.ordered_digests(df, ["g"], "k", "v", "||"))) == {g: digest(v, "||") for g, v in lists.items()}
    assert dict(rows(digests.ordered_texts(df, ["g"], "k", "v", "||"))) == {g: "||".join(v) for g, v in lists.items()}
    assert digests.ordered_digests(df.limit(0), ["g"], "k", "v").collect() == []


def test_digests_of_a_component_of_a_million_variants(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.format_string("v%07d", "id").alias("raw"), (F.col("id") % 3).cast("string").alias("short"))
    comps = spark.range(n).select("id", F.lit(0).cast("long").alias("comp"))
    got = components.component_digests(df, comps, {"raw": "raw", "short": "short"}, "id").first()
    variants = [f"v{i:07d}" for i in range(n)]
    assert got["prompt_id"] == hashlib.sha256(("RAW=" + "||".join(variants) + "\nSHORT=0||1||2").encode()).hexdigest()[:16]
    assert (got["sample_count"], got["raw_variants"], got["short_variants"]) == (n, n, 3)
    assert got["short_hashes"] == ";".join(sorted(digest([v])[:16] for v in "012"))
    assert got["raw_hashes"] == ";".join(sorted(hashlib.sha256(v.encode()).hexdigest()[:16] for v in variants))


def test_paths_and_alignment_equal_the_arrays(spark):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=(int(rng.integers(1, 9)), 3)).tolist(), rng.normal(size=(int(rng.integers(1, 9)), 3)).tolist()) for i in range(25)]
    df = spark.createDataFrame([*data, (98, None, [[1.0, 2.0, 3.0]]), (99, [], [[1.0, 2.0, 3.0]])], "id long, x array<array<double>>, y array<array<double>>")
    paths = alignment.warping_paths(df, "id", "x", "y").cache()
    lengths = df.filter("id < 90").select("id", (F.col("id") % 7 + 1).alias("length"))
    holes = paths.filter("(i + id) % 3 <> 0 AND i >= id % 4")
    got = {(r["id"], r["frame"]): r["values"] for r in alignment.align_frames(alignment.frame_rows(df.filter("id < 90"), "id", "y"), holes, lengths, "id").collect()}
    seen = 0
    for i, x, y in data:
        path, cost = frames.dtw(frames.zscore(x), frames.zscore(y))
        mine = sorted((r["step"], r["i"], r["j"], r["cost"]) for r in paths.filter(f"id = {i}").collect())
        assert [(a, b) for _, a, b, _ in mine] == [tuple(p) for p in path.tolist()] and mine[0][3] == pytest.approx(cost)
        kept = np.array([p for p in path.tolist() if (p[0] + i) % 3 != 0 and p[0] >= i % 4]).reshape(-1, 2)
        want = frames.align(y, kept, i % 7 + 1)
        for t in range(i % 7 + 1):
            assert got[i, t] == pytest.approx(want[t].tolist())
            seen += 1
    assert seen == len(got) and paths.filter("id > 90").count() == 0


def test_batches_and_losses_equal_the_arrays(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=(int(rng.integers(1, 12)), 2)).tolist()) for i in range(23)]
    df = spark.createDataFrame([*data, (50, None), (51, [])], "id long, x array<array<double>>")
    placed = batches.padded(batches.length_batches(df, "id", "x", 5), "x", 2).cache()
    made = {}
    for r in placed.collect():
        made.setdefault(r["batch"], []).append(r)
    order = sorted(data, key=lambda d: (len(d[1]), d[0]))
    assert sorted(made) == [0, 1, 2, 3, 4] and sum(map(len, made.values())) == 23
    losses = {r["batch"]: r for r in batches.masked_losses(placed.withColumn("y", F.transform("padded", lambda f: F.transform(f, lambda v: v * 2 + 1))), "padded", "y", "mask", "batch").collect()}
    for b, part in made.items():
        part.sort(key=lambda r: r["place"])
        assert [r["id"] for r in part] == [i for i, _ in order[5 * b : 5 * b + 5]]
        values, mask = frames.pad_and_mask([np.array(x, np.float64) for _, x in order[5 * b : 5 * b + 5]])
        assert np.allclose([r["padded"] for r in part], values, atol=1e-6) and np.array_equal([r["mask"] for r in part], mask)
        assert [r["padding"] for r in part] == [int((~m).sum()) for m in mask]
        real = mask[:, 1:] & mask[:, :-1]
        assert losses[b]["l1"] == pytest.approx(np.abs(values * 2 + 1 - values)[mask].mean(), rel=1e-5)
        steps = np.abs(values[:, 1:] - values[:, :-1])[real]
        assert losses[b]["smoothness"] == pytest.approx(steps.mean() if steps.size else 0.0, rel=1e-5)
        assert (losses[b]["n_frames"], losses[b]["n_steps"]) == (mask.sum(), real.sum())


def test_feature_flow_resumes_and_records_errors(spark, tmp_path):
    rng = np.random.default_rng(7)
    wave = lambda n: rng.normal(size=n).tolist()
    data = [("a", wave(1600), wave(2000)), ("b", wave(900), wave(640)), ("bad", wave(700), None), ("c", wave(3000), wave(900))]
    df = spark.createDataFrame(data, "k string, x array<double>, y array<double>")
    path = str(tmp_path / "payloads")
    first = {r["k"]: r for r in features.build_features(df.filter("k IN ('a', 'bad')"), "k", "x", "y", path).collect()}
    assert first["a"]["status"] == "generated" and first["bad"]["status"] == "error" and "Error" in first["bad"]["error"]
    again = {r["k"]: r["status"] for r in features.build_features(df, "k", "x", "y", path).collect()}
    assert again == {"a": "exists", "b": "generated", "bad": "error", "c": "generated"}
    payloads = {r["k"]: r for r in spark.read.parquet(path).filter("error = ''").collect()}
    for k, x, y in data:
        if y is None:
            continue
        norm, other = frames.log_mel(np.array(x)).astype(float), frames.log_mel(np.array(y)).astype(float)
        steps, cost = frames.dtw(frames.zscore(norm), frames.zscore(other))
        aligned = frames.align(other, steps, len(norm))
        got = payloads[k]
        assert np.allclose(got["aligned"], aligned) and np.allclose(got["residual"], aligned - norm) and got["cost"] == pytest.approx(cost)
        assert [(p["i"], p["j"]) for p in got["path"]] == [tuple(p) for p in steps.tolist()] and (got["n_norm"], got["n_other"]) == (len(norm), len(other))
    assert first["a"]["residual_l1"] == pytest.approx(np.abs(payloads["a"]["residual"]).mean(), abs=1e-6)
    assert first["a"]["residual_l2"] == pytest.approx(np.sqrt(np.square(payloads["a"]["residual"]).mean()), abs=1e-6)
    embedded = spark.createDataFrame([("e", [[1.0], [2.0], [4.0]], [[1.0], [4.0]], [[0.0, 1.0], [2.0, 3.0]], [[5.0, 5.0]])], f"k string, x {FRAMES}, y {FRAMES}, u {FRAMES}, v {FRAMES}")
    row = features.feature_payloads(embedded, "k", "x", "y", features=None, embeddings=("u", "v")).first()
    assert len(row["norm_embedding"]) == 3 and row["embedding_aligned"] == [[5.0, 5.0]] * 3


FRAMES = "array<array<double>>"
LEXICON = [("銀行", "ngan4hong4"), ("銀", "ngan4"), ("行", "hang4"), ("你", "nei5"), ("銀行家", "ngan4hong4gaa1"), ("家好人", "x"), ("行", "zzz"), ("", "none"), ("空", None)]


def test_readings_by_trie_and_by_join(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, reading string")
    texts = [(1, "你銀行行"), (2, "銀行家好"), (3, ""), (4, None), (5, "空x銀"), (6, "你銀行行"), (7, "銀" * 3000)]
    df = spark.createDataFrame(texts, "id int, t string")
    want = [(1, "nei5 ngan4hong4 hang4"), (2, "ngan4hong4gaa1 UNK:好"), (3, ""), (4, None), (5, "UNK:空 UNK:x ngan4"), (6, "nei5 ngan4hong4 hang4"), (7, " ".join(["ngan4"] * 3000))]
    for limit in (readings.LEXICON_BYTES, 0):
        assert rows(readings.with_readings(df, "t", lexicon, limit=limit).select("id", "reading")) == sorted(want, key=repr)
    words = F.create_map(*[F.lit(x) for w, r in LEXICON[:5] for x in (w, r)])
    same = df.filter("id < 4").select("id", text.phonetic_key(F.col("t"), words, longest=3))
    assert rows(same) == sorted(want[:3], key=repr)
    assert rows(readings.with_readings(df, "t", lexicon.limit(0)).filter("id = 3 OR id = 5").select("reading")) == [("",), ("UNK:空 UNK:x UNK:銀",)]


def test_phrases_are_converted_by_the_longest_match(spark):
    phrases = spark.createDataFrame([("头发", "頭髮"), ("发", "發"), ("头", "頭"), ("发现", "發現")], "word string, reading string")
    df = spark.createDataFrame([(1, "头发发现a头 发"), (2, ""), (3, None)], "id int, t string")
    for limit in (readings.LEXICON_BYTES, 0):
        assert rows(readings.with_phrases(df, "t", phrases, "out", limit).select("id", "out")) == [(1, "頭髮發現a頭 發"), (2, ""), (3, None)]


def test_expectations_as_a_table_and_as_checks(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 2.05), (3, "b", float("nan")), (4, "a", None)], "id int, s string, v double")
    rules = spark.createDataFrame([("s", "a", None, "error"), ("v", "2", 0.1, "warning"), ("gone", "1", None, "error"), ("id", "x", 1.0, "error")], "column string, value string, tolerance double, severity string")
    got = rows(audit.expectation_issues(df.filter("id <> 1"), rules.filter("column <> 'id'"), "id"))
    want = [("error", "s_mismatch", "2", "s: missing"), ("error", "s_mismatch", "3", "s: b"), ("warning", "v_mismatch", "3", "v: NaN"), ("warning", "v_mismatch", "4", "v: missing")]
    assert got == sorted([*want, *[("error", "gone_mismatch", str(i), "gone: missing") for i in (2, 3, 4)]], key=repr)
    assert audit.expectation_issues(df, rules.filter("column = 'id'"), "id").count() == 4  # a number within 1 of no number
    found = rows(audit.issues(df, audit.expected_values(df, {"s": "a", "v": 2.0}, tolerance=0.1), "id"))
    assert [(code, key) for _, code, key, _ in found] == [("s_mismatch", "2"), ("s_mismatch", "3"), ("v_mismatch", "3"), ("v_mismatch", "4")]


def test_results_joined_in_order_and_text_contract(spark):
    left = spark.createDataFrame([("u2", "train"), ("u1", "train"), ("u3", "dev"), ("u9", "dev")], "utt_id string, split string")
    right = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3), ("u7", 7)], "utt_id string, r int")
    assert [tuple(r) for r in manifest.with_results(left, right).select("split", "utt_id", "r").collect()] == [("dev", "u3", 3), ("train", "u1", 1), ("train", "u2", 2)]
    texts = spark.createDataFrame([("language Cantonese<asr_text>x",), ("x",), (None,), ("language English<asr_text>x",)], "t string")
    assert [r[0] for r in texts.select(manifest.has_text_prefix(F.col("t"))).collect()] == [True, False, None, False]
    assert [r[0] for r in texts.select(manifest.has_text_prefix(F.col("t"), "English")).collect()] == [False, False, None, True]


def test_steps_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([(100,), (1,), (0,)], "n int")
    assert [r[0] for r in df.select(metrics.steps_per_epoch(F.col("n"), 8, 4)).collect()] == [4, 1, 0]
    last = spark.createDataFrame([(10,), (3,), (8,)], "n int")
    assert [r[0] for r in last.select(metrics.step_grid(F.col("n"), 4)).collect()] == [[4, 8, 10], [3], [4, 8]]
    row = spark.createDataFrame([("é", None, 2.5)], "a string, b string, c double")
    assert json.loads(tables.summary_json(row)) == {"a": "é", "b": None, "c": 2.5}
    tables.write_csv(spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "k string, v string").coalesce(1), str(tmp_path / "s"), ["k", "v"])
    assert tables.read_keyed(spark, str(tmp_path / "s"), ["k", "v"], "k") == {"x": {"k": "x", "v": "3"}, "y": {"k": "y", "v": "2"}}


def test_a_stream_restarts_from_its_checkpoint_and_counts_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    seconds = lambda *at: spark.createDataFrame([(s, "a", 1.0) for s in at], "s long, event_type string, value double").select(F.col("s").alias("event_id"), F.timestamp_seconds("s").alias("ts"), "event_type", "value").coalesce(1)
    heard = []
    listener = audit.Progress(lambda line: heard.append(json.loads(line)))
    spark.streams.addListener(listener)
    try:
        late = 0
        for part in (seconds(0, 10, 3600, 40000), seconds(20, 41000, 50000)):
            part.write.mode("append").parquet(str(tmp_path / "in"))
            found = windows.run_windows(windows.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check"))
            late += sum(s.numRowsDroppedByWatermark for p in found for s in p.stateOperators)
    finally:
        spark.streams.removeListener(listener)
    got = {r["window_start"].timestamp(): r["n"] for r in windows.latest_windows(spark, str(tmp_path / "out")).select(F.col("window_start").cast("timestamp"), "n").collect()}
    assert sorted(got.values()) == [1, 1, 2, 2] and late == 1  # 20 came after its window had closed; 41000 joined 40000
    lines = [x for x in heard if x["event"] == "progress"]
    assert {"batch", "rows", "late", "seconds"} <= set(lines[0])


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    links = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(25)] + [(39, 100), (500, 501), (501, 500), (7, 7)]
    rng = random.Random(2)
    name = dict(zip(range(600), rng.sample(range(600), 600), strict=True))
    edges = [(name[a], name[b]) for a, b in links]
    got = dict(rows(components.label_components(spark.createDataFrame(edges, "a long, b long"))))
    one = min(name[i] for i in [*range(40), *range(100, 126)])
    assert got == {**{name[i]: one for i in [*range(40), *range(100, 126)]}, name[500]: min(name[500], name[501]), name[501]: min(name[500], name[501])}


def test_a_missing_prediction_is_an_error_for_a_count_too(spark):
    base = spark.createDataFrame([(1, 0.5, 0.4), (2, 0.5, 0.4)], "utt_id int, zero_shot_cer double, baseline_cer double")
    new = spark.createDataFrame([(1, 0.9, True, 1)], "utt_id int, cer double, critical boolean, position int")
    for read in (lambda df: df.count(), lambda df: df.select("utt_id").collect(), lambda df: df.collect()):
        with pytest.raises(Exception, match="rows without a new prediction: 2"):
            read(compare.three_way(base, new))
    assert compare.three_way(base.filter("utt_id = 1"), new).count() == 1

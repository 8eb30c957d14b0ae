"""Operators on small tables with known answers."""

import inspect
import json
import os

import pytest
from pyspark.sql import functions as F

from talus.operators import audit, compare, components, dedupe, infer, leakage, manifest, sampling, splits, summary
from talus.operators.shared import ranked
from talus.plans import queries
from talus.sources import audio, tables
from talus.sources.sample import write_sample_tree
from talus.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, pos int, v string")
    assert rows(dedupe.keep_first(df, ["k"], "pos")) == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(dedupe.keep_last(df, ["k"], "pos")) == [("a", 2, "y"), ("b", 3, "z")]
    assert rows(dedupe.later_duplicates(df, ["k"], "pos")) == [("a", 2, "y")]


def test_merge_lets_blanks_of_the_right_side_win(spark):
    left = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, w string")
    right = spark.createDataFrame([(1, "", 5)], "k int, v string, n int")
    assert rows(dedupe.merged(left, right, "k").select("k", "v", "w", "n")) == [(1, "", "p", 5), (2, "b", "q", None)]


def test_three_way_needs_every_row(spark):
    base = spark.createDataFrame([(1, 0.5, 0.4)], "utt_id int, zero_shot_cer double, baseline_cer double")
    new = spark.createDataFrame([(1, 0.9, True, 1), (1, 0.1, False, 2), (7, 0.0, False, 1)], "utt_id int, cer double, critical boolean, position int")
    assert compare.three_way(base, new).first()["new_method_cer"] == 0.1
    with pytest.raises(Exception, match="rows without a new prediction"):
        compare.three_way(base, new.filter("utt_id = 7")).collect()


@pytest.mark.parametrize(("n", "wanted"), [(3, (3, 0, 0)), (4, (3, 0, 1)), (9, (8, 0, 1)), (10, (8, 1, 1)), (15, (11, 2, 2)), (25, (21, 2, 2))])
def test_within_speaker_split_sizes(spark, n, wanted):
    df = spark.createDataFrame([("s", f"p{i}") for i in range(n)] * 2, "speaker string, prompt string")
    got = {r["split"]: r["n"] for r in manifest.within_speaker_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert tuple(got.get(s, 0) for s in ("train", "dev", "test")) == wanted


def test_meta_speech_exceptions(spark):
    df = spark.createDataFrame([("大聲講", "x"), ("x", "大聲"), ("一開始錄", "x"), ("x", "開始錄"), ("x", "開始 一"), ("x", "y")], "gt string, pred string")
    got = [r[0] for r in df.coalesce(1).select(manifest.is_meta_speech(F.col("gt"), F.col("pred"))).collect()]
    assert got == [False, True, False, True, True, False]


def test_classification_ladder(spark):
    df = spark.createDataFrame(
        [("k_HD", "1", "1. 食咗飯未？", "x", 3.0, 0.1, False), ("k", "2", "早晨", "x", 3.0, 0.1, False), ("k_SCA", "3", "今日天氣好好呀我哋", "x", None, 0.1, False), ("k_x", "4", "今日天氣好好呀我哋", "x", 30.0, 0.6, True), ("k_HD", "5", "今日天氣好好呀我哋", "x", 3.0, None, False)],
        "speaker string, audio_id string, gt string, pred string, duration double, cer double, critical boolean",
    )
    got = {r["audio_id"]: r for r in manifest.classify(df).collect()}
    assert [got[str(i)]["task_type"] for i in range(1, 6)] == ["open_question_answer", "short_word", "read_sentence", "read_sentence", "read_sentence"]
    assert [got[str(i)]["split"] for i in range(1, 6)] == ["excluded", "analysis_only", "excluded", "pending", "pending"]
    assert [got[str(i)]["quality_label"] for i in range(1, 6)] == ["prompt_answer_mismatch", "short_word_analysis_only", "needs_attention", "needs_attention", "ok"]
    assert got["4"]["cleaning_flags"] == ["duration_very_long", "zero_shot_critical"] and got["5"]["zero_shot_bucket"] == "unknown" and got["4"]["disease_tag"] == "unknown"


def test_movement_rates_without_a_denominator(spark):
    df = spark.createDataFrame([("a", True, False), ("a", True, True), ("b", False, False)], "d string, zero_shot_critical boolean, new_method_critical boolean")
    got = {r["d"]: r for r in compare.movement_by(df, "d").collect()}
    assert got["a"]["rescued_rate"] == 0.5 and got["a"]["regression_rate"] is None and got["b"]["rescued_rate"] is None


def test_best_checkpoint_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.3)], "run string, step int, cer double")
    assert rows(compare.best_checkpoint(df)) == [("r", 2, 0.3)]
    assert [r["improved"] for r in compare.best_so_far(df).orderBy("step").collect()] == [True, True, False]


def test_leakage_ignores_blank_keys_and_previews(spark):
    train = spark.createDataFrame([(i, "x", "") for i in range(30)], "utt_id int, raw string, norm string")
    test = spark.createDataFrame([(100, "x", ""), (101, "y", "")], "utt_id int, raw string, norm string")
    got = {(r["utt_id"], r["layer"]): r for r in leakage.match(test, train, {"raw": "raw", "norm": "norm"}).collect()}
    assert got[100, "raw"]["match_count"] == 30 and got[100, "raw"]["matched_ids"].count(";") == 19
    assert not got[101, "raw"]["seen"] and not got[100, "norm"]["seen"]


def test_components_follow_chains_and_blank_keys(spark):
    chain = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(20)] + [(50, None, "z"), (51, "", "y"), (60, "q", "r")]
    got = dict(rows(components.prompt_components(spark.createDataFrame(chain, "utt_id int, p string, q string"), {"p": "p", "q": "q"})))
    assert {got[i] for i in range(20)} == {0} and got[50] == got[51] == 50 and got[60] == 60


def test_split_score_golden(spark):
    """Sizes, shares and least contents by hand for four rows."""
    df = spark.createDataFrame([("train", "s", "hard", "short", "HD")] * 2 + [("dev", "s", "hard", "short", "HD"), ("test", "s", "hard", "short", "HD")], "split string, speaker_id string, zero_shot_bucket string, duration_bucket string, disease_tag string")
    got = splits.score_split(df, (0.5, 0.25, 0.25), "f").first()["score"]
    assert got == pytest.approx(2 * (24 * 1.0 + 34 * 0.3 + 3 * 2.0))


def test_search_agrees_with_scorer_and_beats_the_worst(spark):
    df = spark.createDataFrame([(f"g{i % 12}", f"s{i % 5}", ("hard", "easy")[i % 3 == 0], "short", "HD") for i in range(90)], "g string, speaker_id string, zero_shot_bucket string, duration_bucket string, disease_tag string")
    best = splits.search_split(df, "g", (0.6, 0.2, 0.2), trials=40)
    scored = splits.score_split(df.join(best.drop("score"), "g"), (0.6, 0.2, 0.2)).first()["score"]
    assert scored == pytest.approx(best.first()["score"]) and best.count() == 12


def test_search_runs_all_trials_of_the_reference(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{i % 30}", f"s{i % 7}", ("hard", "easy", "medium")[i * i % 3], ("short", "long")[i % 5 == 0], ("HD", "SCA")[i % 4 == 0]) for i in range(95)], "g string, speaker_id string, zero_shot_bucket string, duration_bucket string, disease_tag string")
    whole = sorted(map(tuple, splits.search_split(df, "g", (0.8, 0.1, 0.1), trials=500).collect()))
    assert whole == sorted(map(tuple, splits.search_split(df, "g", (0.8, 0.1, 0.1), trials=500, chunk=180).collect()))
    asked, search = [], splits.search_split
    monkeypatch.setattr(splits, "search_split", lambda *a, **k: asked.append(k.get("trials")))
    monkeypatch.setattr(queries, "utterances", lambda *a: df.withColumn("disease_tag", df.disease_tag))
    queries.QUERIES["split_search"](spark, "")
    assert asked == [30_000] and inspect.signature(search).parameters["trials"].default == 30_000


def test_issue_rows(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, "x")], "id int, v double, s string")
    found = audit.issues(df, [audit.Check("error", "big", F.col("v") > 1, F.lit("v")), audit.Check("warning", "blank", F.col("s").isNull(), F.lit("s"))], "id")
    assert rows(found) == [("error", "big", "1", "v"), ("warning", "blank", "1", "s")]
    assert audit.counts_map(found, "code").first()["counts"] == {"big": 1, "blank": 1}


def test_frame_checks(spark):
    good = ([[1.0, 2.0]], [[2.0, 2.0]], [[1.0, 0.0]])
    bad = ([[1.0, 2.0]], [[2.0, float("nan")]], [[5.0, 0.0], [1.0, 1.0]])
    df = spark.createDataFrame([(1, *good), (2, *bad), (3, None, [[1.0]], [[1.0]])], "id int, norm array<array<double>>, aligned array<array<double>>, residual array<array<double>>")
    found = audit.issues(df, audit.frame_checks({"norm": 2, "aligned": 2, "residual": 2}, ["norm", "aligned", "residual"]), "id")
    codes = {(r["key"], r["code"]) for r in found.collect()}
    assert not any(k == "1" for k, _ in codes) and {("2", "not_finite"), ("2", "unequal_length"), ("2", "residual_mismatch"), ("3", "missing_array"), ("3", "bad_width")} <= codes


def test_percentiles_and_counts(spark):
    got = summary.percentiles(spark.range(101), "id").first()
    assert (got["p01"], got["median"], got["p99"], got["mean"]) == (1.0, 50.0, 99.0, 50.0)
    assert rows(summary.vocabulary(spark.createDataFrame([("b",), ("a",), ("b",)], "v string"), "v")) == [("a", 0), ("b", 1)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("split", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    assert rows(sampling.hash_sample(df, 20, "id")) == rows(sampling.hash_sample(df.repartition(7), 20, "id"))
    assert rows(sampling.driver_shuffle(df, 5, "id")) == rows(sampling.driver_shuffle(df.repartition(3), 5, "id"))
    assert {0, 1, 498, 499} <= {r["id"] for r in sampling.edges_and_sample(df, 10, "id").collect()}


def test_inference_retries_rows_and_resumes(spark, tmp_path):
    class Flaky:  # local, so that it travels to the workers by value
        def transcribe(self, inputs):
            if (len(inputs) > 1 and "b" in inputs) or inputs == ["x"]:
                raise RuntimeError("no")
            return [i * 2 for i in inputs]

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x")], "k int, s string").coalesce(1)
    got = {r["k"]: (r["pred"], r["inference_error"]) for r in infer.batch_infer(df, Flaky, key="k", source="s").collect()}
    assert got == {"1": ("aa", ""), "2": ("bb", ""), "3": ("", "RuntimeError: no")}
    path = str(tmp_path / "out")
    infer.resume_infer(df.filter("k < 3"), None, Flaky, key="k", source="s", path=path, run="1")
    for _ in range(2):  # a run that is repeated replaces itself
        every = infer.resume_infer(df, spark.read.parquet(f"{path}/run=1"), Flaky, key="k", source="s", path=path, run="2")
        assert every.count() == 3 and every.select("k").distinct().count() == 3
    with pytest.raises(Exception, match="no"):
        infer.infer_or_fail(df, Flaky, key="k", source="s").collect()
    assert rows(infer.infer_or_fail(df.filter("k = 1"), Flaky, key="k", source="s")) == [("1", "aa")]


def test_one_input_and_spoken_texts(spark):
    assert infer.smoke(spark, queries.FakeTranscriber, "see") == "sxx"
    df = spark.createDataFrame([(1, "one"), (2, "A"), (3, None)], "k int, t string")
    got = {r["k"]: (r["status"], r["audio"] and bytes(r["audio"]), r["error"]) for r in infer.synthesize(df, df.filter("k = 1"), queries.FakeModel, key="k", text="t").collect()}
    assert got == {"1": ("exists", None, ""), "2": ("error", None, "RuntimeError: no voice"), "3": ("generated", b"", "")}
    again = infer.synthesize(df, df, queries.FakeModel, key="k", text="t", overwrite=True)
    assert again.filter("status = 'exists'").count() == 0


def test_csv_and_jsonl_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", b', None), ("2", "line\nbreak", "聲")], "id string, a string, b string")
    tables.write_csv(df, str(tmp_path / "c"), ["id", "a", "b", "none"])
    assert rows(tables.read_csv(spark, str(tmp_path / "c"), ["id", "a", "b", "none"])) == [("1", 'a "q", b', "", ""), ("2", "line\nbreak", "聲", "")]
    with pytest.raises(ValueError, match="unexpected"):
        tables.write_csv(df, str(tmp_path / "d"), ["id"], strict=True)
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert tables.count_lines(spark, str(tmp_path / "j")) == 2
    assert rows(tables.read_jsonl(spark, str(tmp_path / "j"), df.schema, required=["id", "b"])) == rows(df)
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_jsonl(spark, str(tmp_path / "j"), df.schema, required=["zz"])
    assert tables.to_markdown(spark.createDataFrame([("a|b",)], "c string")).endswith("| a\\|b |")


def test_progress_log_keeps_the_last_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k":"a","v":1}\n\n{"k":"b","v":2}\n{"k":"a","v":3}\n')
    assert rows(tables.read_jsonl_cache(spark, str(tmp_path / "log.jsonl"), "k string, v int", "k")) == [("a", 3), ("b", 2)]


def test_discovery_headers_and_transcripts(spark, tmp_path):
    root = str(tmp_path / "data")
    write_sample_tree(spark, root)
    with open(os.path.join(root, "a_HD/s1/transcript.txt"), "w") as f:
        f.write("filename,transcript\nu1.wav,one, two\nno comma\n")
    with open(os.path.join(root, "a_HD/s1/u2.lab"), "w") as f:
        f.write(" lab text \n")
    files = audio.discover(spark, root)
    got = {r["audio_id"]: r for r in audio.with_transcripts(files.withColumn("h", audio.wav_header("content")), audio.labels(spark, root), audio.transcripts(spark, root)).collect()}
    assert got["u1"]["h"]["duration_sec"] == 1.0 and got["u2"]["h"]["channels"] == 2 and got["u3"]["h"]["error"].startswith("ValueError")
    assert (got["u1"]["gt"], got["u1"]["gt_source"]) == ("one, two", "transcript.txt") and (got["u2"]["gt"], got["u2"]["gt_source"]) == ("lab text", ".lab")
    assert got["u1"]["session"] == "s1" and got["u3"]["session"] == "" and got["u3"]["gt"] == ""


def test_label_files_must_be_complete(spark, tmp_path):
    root = str(tmp_path / "pairs")
    write_sample_tree(spark, root)
    files = audio.discover(spark, root).filter("audio_id = 'u1'")
    with pytest.raises(ValueError, match="without a label file"):
        audio.paired_labels(files, audio.labels(spark, root))
    (tmp_path / "pairs/a_HD/s1/u1.lab").write_text("one")
    assert audio.paired_labels(files, audio.labels(spark, root)).first()["gt"] == "one"
    with pytest.raises(ValueError, match="empty"):
        audio.paired_labels(files.limit(0), audio.labels(spark, root))
    mono = audio.discover(spark, root).filter("audio_id = 'u2'").select(audio.wav_mono("content", F.lit(8000)).alias("w")).first()["w"]
    assert len(mono) == 2000 and audio.missing_files(spark.createDataFrame([("x",)], "path string"), "path", files).count() == 1


def test_checkpoints_to_keep(spark, tmp_path):
    for name in ("checkpoint-2", "checkpoint-10", "other"):
        (tmp_path / name).mkdir()
    found = audio.checkpoint_folders(spark, str(tmp_path))
    assert audio.latest_checkpoint(found).first()["step"] == 10
    kept = audio.retention(found, spark.createDataFrame([("r", 2, 0.1)], "run string, best_step long, best_score double"))
    assert {(r["step"], r["keep"]) for r in kept.collect()} == {(2, True), (10, False)}


def test_required_rows_and_prefixes(spark):
    df = spark.createDataFrame([(2, 5.0), (1, None), (3, 9.0)], "utt_id int, duration double")
    assert [r["utt_id"] for r in sampling.longest(df, 3).collect()] == [3, 2, 1] and sampling.head(df, 0, "utt_id").count() == 3
    assert [r["utt_id"] for r in sampling.head(df, 2, "utt_id").collect()] == [1, 2]
    assert [r["utt_id"] for r in dedupe.require_all(spark.createDataFrame([(3,), (1,)], "utt_id int"), df, "utt_id").collect()] == [1, 3]
    with pytest.raises(ValueError, match="missing rows: 7, 8"):
        dedupe.require_all(spark.createDataFrame([(8,), (7,), (1,)], "utt_id int"), df, "utt_id")
    with pytest.raises(ValueError, match="empty"):
        dedupe.require_rows(df.limit(0))
    joined, missing = dedupe.matched_and_missing(df, spark.createDataFrame([(1, "x")], "utt_id int, v string"), "utt_id")
    assert joined.count() == 1 and {r[0] for r in missing.collect()} == {2, 3}
    rows_of = spark.createDataFrame([("train", "generated"), ("train", None), ("train", "exists"), ("dev", "generated")], "split string, status string")
    assert manifest.of_split(rows_of, "train").count() == 1 and manifest.without(rows_of, ["split", "none"]).columns == ["split"]


def test_modules_of_presets(spark):
    names = spark.createDataFrame([("audio.layers.0.q_proj",), ("audio.layers.0.out_proj",), ("text.layers.0.q_proj",), ("audio.fc1",)], "name string")
    got = lambda preset: [r[0] for r in audit.target_modules(names, begins=("audio.",), ends=audit.PRESET_ENDS[preset]).collect()]
    assert got("attn_qkv") == ["audio.layers.0.q_proj"] and got("attn_qkvo") == ["audio.layers.0.out_proj", "audio.layers.0.q_proj"] and got("ffn") == ["audio.fc1"]
    with pytest.raises(ValueError, match="empty"):
        audit.target_modules(names, begins=("none.",))


def test_split_score_of_the_published_audit(spark):
    """The published split by its counts: buckets, durations, tags, distinct speakers and rows of the focal speaker."""
    counts = {
        "train": (71, 54, (1092, 608, 459), (18, 497, 1400, 241, 3), (96, 208, 1855)),
        "dev": (61, 6, (140, 78, 55), (2, 62, 189, 20, 0), (12, 24, 237)),
        "test": (43, 6, (135, 78, 62), (1, 65, 174, 34, 1), (12, 26, 237)),
    }
    buckets, durations, tags = ("easy", "medium", "hard"), ("very_short", "short", "medium", "long", "very_long"), ("HD", "SCA", "unknown")
    made, spell = [], lambda names, ns: [n for n, k in zip(names, ns, strict=True) for _ in range(k)]
    for split, (speakers, focal, *parts) in counts.items():
        columns = [spell(names, ns) for names, ns in zip((buckets, durations, tags), parts, strict=True)]
        made += [(split, "focal" if i < focal else f"s{i % (speakers - 1)}", *row) for i, row in enumerate(zip(*columns, strict=True))]
    df = spark.createDataFrame(made, "split string, speaker_id string, zero_shot_bucket string, duration_bucket string, disease_tag string")
    assert round(splits.score_split(df, (0.8, 0.1, 0.1), "focal").first()["score"], 6) == 1.358495


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "three  four"), (3, None), (4, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "three four"), (2, "two three four five six seven eight nine"), (3, "x"), (4, ""), (5, None), (6, "one two three four five six seven eight ten")], "item_id long, text string")
    assert rows(leakage.passage_containment(docs, items)) == [(1, 1), (1, 2), (2, 1), (4, 3)]


def test_numbers_of_rows_in_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id"))
    got = {r["row_no"]: r["v"] for r in ranked(df, "v").collect()}
    assert got == {i + 1: i for i in range(1000)} and ranked(df.limit(0), "v").count() == 0
    empty = summary.percentiles(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert empty["p01"] is None and summary.percentiles(spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double"), "x").first()["median"] == 1.5


def test_progress_lines(spark, tmp_path):
    import time

    lines = []
    listener = audit.Progress(lines.append)
    spark.streams.addListener(listener)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    windows.process_new(windows.read_stream(spark, str(tmp_path / "in"), "id long"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "mark"))
    for _ in range(50):
        if any('"ended"' in line for line in lines):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(json.loads(line).get("rows", 0) for line in lines) == 5


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("x/checkpoint-9",), ("x/checkpoint-10",), ("x/other",)], "path string")
    assert rows(audio.latest_checkpoint(df)) == [("x/checkpoint-10", 10)]


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(5).write.parquet(source)
    stream = lambda: windows.read_stream(spark, source, "id long")
    windows.process_new(stream(), lambda b: b, out, mark)
    spark.range(5, 8).write.mode("append").parquet(source)
    windows.process_new(stream(), lambda b: b, out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_stratified_sample_computes_its_rows_once(spark):
    """Round robin against a loop, also beyond the number of rows; the bucket, which may be dear, is computed once a row."""
    names = ["hard", "hard", "hard", "medium", "easy", "other", None]
    rows = [(i * 37 % 1301, names[i * i % 7]) for i in range(1301)]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(name):
        calls.add(1)
        return name

    df = spark.createDataFrame(rows, "utt_id long, name string")
    for n in (1, 7, 1200):
        heads = [[(k, name) for k, name in sorted(rows, key=lambda r: r[0]) if name == wanted] for wanted in manifest.BUCKET_ORDER]
        want = [h[i] for i in range(len(rows)) for h in heads if i < len(h)][:n]
        before = calls.value
        got = manifest.stratified_sample(df.withColumn("zero_shot_bucket", dear("name")), n).select("utt_id", "zero_shot_bucket")
        assert [tuple(r) for r in got.collect()] == want
        assert calls.value - before == len(rows)

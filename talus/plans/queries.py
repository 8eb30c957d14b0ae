"""Registered queries, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import metrics, readings, text
from talus.functions.frames import interpolate_udf, log_mel_udf, mean_abs, residual, root_mean_square, zscore_udf
from talus.operators import alignment, audit, batches, compare, components, dedupe, features, infer, leakage, manifest, sampling, sequences, splits, summary
from talus.operators.shared import Workspace, shared_folder
from talus.plans.fixture import METHODS, PIECES_SQL, UTTERANCES_SQL, distance, pieces, table, utterances
from talus.sources import audio, staged, tables
from talus.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = "一二三十百千廿卅冇沒咩嘢野啊吖畀岩的钟意汉红黄声体开"
DIMS = ["zero_shot_bucket", "disease_tag", "duration_bucket", "speaker_id"]
LAYERS = {"raw": "gt", "normalized": "normal", "skeleton": "skeleton"}


def _exact_means(sql: str) -> str:
    """Averages of rates, which have six decimals, from exact sums of millionths, as ``summary.plain_mean`` takes them from decimals."""
    fits = r"try_cast(round(\1 * 1000000) AS BIGINT)"
    total = rf"(CASE WHEN count({fits})\2 = count(\1)\2 THEN sum({fits})\2::DOUBLE / 1000000 ELSE sum(\1)\2 END)"
    return re.sub(r"avg\((\w+_cer|[cbwz])\)( FILTER \((?:[^()]|\([^()]*\))*\))?", rf"({total} / count(\1)\2)", sql)


def query(sql: str | None = None, u: bool = False, p: bool = False) -> Callable[[Query], Query]:
    """Registers a query; ``u`` and ``p`` put the utterances or pieces before its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _exact_means(f"WITH {UTTERANCES_SQL if u else PIECES_SQL}{sql}" if u or p else sql)
        return f

    return add


# rates, flags and buckets


@query(" SELECT utt_id, zero_shot_cer, baseline_cer, new_method_cer FROM u", u=True)
def cer_per_row(spark, sf):
    return utterances(spark, sf).select("utt_id", "zero_shot_cer", "baseline_cer", "new_method_cer")


@query(f""" SELECT utt_id, round_even({distance("lower(gt)", "lower(zero_pred)")}::DOUBLE / greatest(length(gt), 1), 6) cer FROM u""", u=True)
def cer_cjk_per_row(spark, sf):
    sign = lambda c: F.translate(F.lower(c), LETTERS, SIGNS)
    return utterances(spark, sf).select("utt_id", metrics.rounded(metrics.cer(sign(F.col("gt")), sign(F.col("zero_pred")))).alias("cer"))


@query(f""", r AS (SELECT *, {distance("gt", "new_pred")}::DOUBLE / greatest(length(gt), 1) raw, regexp_replace(new_pred, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g') bare FROM u)
SELECT count(*) n, count_if(trim(new_pred) = '' OR round_even(raw, 6) >= 0.5) rounded_raw, count_if(bare = '' OR raw >= 0.5) unrounded_bare,
 count_if(utt_id % 11 = 0 OR trim(new_pred) = '' OR round_even(raw, 6) >= 0.5) with_errors FROM r""", u=True)
def critical_dialects(spark, sf):
    rate, pred = metrics.cer(F.col("gt"), F.col("new_pred")), F.col("new_pred")
    bare, error = F.regexp_replace("new_pred", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", ""), F.when(F.col("utt_id") % 11 == 0, "E: x").otherwise("")
    return utterances(spark, sf).agg(
        F.count("*").alias("n"), F.count_if(metrics.critical(rate, pred)).alias("rounded_raw"), F.count_if(metrics.critical(rate, bare, on_rounded=False)).alias("unrounded_bare"),
        F.count_if(metrics.critical(rate, pred, error=error)).alias("with_errors"),
    )


@query(" SELECT duration_bucket, count(*) n FROM u GROUP BY 1", u=True)
def duration_bucket_counts(spark, sf):
    return summary.value_counts(utterances(spark, sf), "duration_bucket")


@query(" SELECT zero_shot_bucket, CASE WHEN zero_shot_cer >= 0.5 THEN 'hard' WHEN zero_shot_cer < 0.2 THEN 'easy' ELSE 'medium' END cer_bucket, count(*) n FROM u GROUP BY ALL", u=True)
def zero_shot_bucket_counts(spark, sf):
    return summary.value_counts(utterances(spark, sf).withColumn("cer_bucket", metrics.cer_bucket(F.col("zero_shot_cer"))), "zero_shot_bucket", "cer_bucket")


_SETS = lambda dims: "GROUPING SETS ((), " + ", ".join(f"({d})" for d in dims) + ")"
_LABEL = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}=' || {d}" for d in DIMS) + " ELSE 'overall' END"
_KIND = lambda dims: "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims) + " ELSE 'overall' END"
_VALUE = lambda dims: "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN {d}" for d in dims) + " ELSE 'all' END"


@query(f""" SELECT {_LABEL} "group", count(*) sample_count, round_even(avg(zero_shot_cer), 6) before_cer, round_even(avg(new_method_cer), 6) after_cer,
 round_even(avg(new_method_cer) - avg(zero_shot_cer), 6) delta_cer, round_even(avg(zero_shot_critical::INT), 6) before_critical_rate,
 round_even(avg(new_method_critical::INT), 6) after_critical_rate, round_even(avg(new_method_critical::INT) - avg(zero_shot_critical::INT), 6) delta_critical_rate, count_if(zero_shot_critical) before_critical_count, count_if(new_method_critical) after_critical_count
FROM u GROUP BY {_SETS(DIMS)}""", u=True)
def stratified_summary(spark, sf):
    return summary.stratified_summary(utterances(spark, sf), DIMS, ("zero_shot_cer", "zero_shot_critical"), ("new_method_cer", "new_method_critical"))


_LONG = ["zero_shot_bucket", "disease_tag", "duration_bucket", "split"]


@query(f""" SELECT 'all' scope, {_KIND(_LONG)} group_type, {_VALUE(_LONG)} group_value, count(*) sample_count, count_if(new_pred <> '') inferred_count,
 round_even(avg(new_method_cer), 6) avg_cer, round_even(avg(new_method_critical::INT), 6) avg_critical, count_if(new_method_critical) critical_count,
 count(new_method_critical) critical_labeled, round_even(avg(duration), 6) avg_duration FROM u GROUP BY {_SETS(_LONG)}""", u=True)
def stratified_summary_long(spark, sf):
    rows = utterances(spark, sf).withColumns({"pred": F.col("new_pred"), "cer": F.col("new_method_cer"), "critical": F.col("new_method_critical")})
    return summary.performance_long(rows, _LONG, "all")


@query(""" SELECT CASE WHEN grouping(speaker_id) = 1 THEN '__OVERALL__' ELSE speaker_id END speaker_id, count(*) samples_total, count_if(zero_pred <> '') inferred_total,
 count_if(gt <> '') gt_total, round_even(avg(zero_shot_cer), 6) avg_cer, round_even(avg(zero_shot_critical::INT), 6) critical_rate, count_if(zero_shot_critical) critical_count,
 count(zero_shot_critical) critical_labeled FROM u GROUP BY ROLLUP (speaker_id)""", u=True)
def speaker_summary_rollup(spark, sf):
    return summary.speaker_summary(utterances(spark, sf).withColumns({"pred": F.col("zero_pred"), "cer": F.col("zero_shot_cer"), "critical": F.col("zero_shot_critical")}))


@query(f""", f AS (SELECT 'raw' form, gt a, zero_pred b FROM u UNION ALL SELECT 'normalized', replace(gt, ' ', ''), replace(zero_pred, ' ', '') FROM u UNION ALL SELECT 'textnorm', lower(replace(gt, ' ', '')), lower(replace(zero_pred, ' ', '')) FROM u)
SELECT form, sum({distance("a", "b")})::BIGINT distance, sum(greatest(length(a), 1))::BIGINT length, count_if(a = b) exact,
 round_even(sum({distance("a", "b")}) / sum(greatest(length(a), 1)), 6) cer, round_even(count_if(a = b) / count(*), 6) exact_rate FROM f GROUP BY form""", u=True)
def corpus_cer_micro(spark, sf):
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return summary.corpus_cer(utterances(spark, sf), {"raw": (F.col("gt"), F.col("zero_pred")), "normalized": (bare("gt"), bare("zero_pred")), "textnorm": (text.normalize_degraded(F.col("gt")), text.normalize_degraded(F.col("zero_pred")))})


# text


_PUNCT_SQL = "translate({}, '" + text.PUNCTUATION.replace("'", "''") + "', '')"
_CJK_SQL = f"translate(lower(gt), '{LETTERS}', '{SIGNS}')"


@query(" SELECT doc_id, md5(" + _PUNCT_SQL.format(r"regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g')") + ") normalized FROM documents")
def normalize_basic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_basic(F.col("text"))).alias("normalized"))


@query(" SELECT doc_id, n, translate(lower(gt), 'abcdefghij', '0123456789') digits FROM pc", p=True)
def normalize_digits_run(spark, sf):
    """Letters become numerals, every run of them of two or more is read as digits, and single ones are left."""
    signs = F.translate(F.lower("gt"), "abcdefghij", "零一二三四五六七八九")
    read = F.translate(text.normalize_numerals(signs), text.NUMERALS, text.NUMERAL_DIGITS)
    return pieces(spark, sf).select("doc_id", F.col("n").cast("long").alias("n"), read.alias("digits"))


_RUN = f"[{text.NUMERALS}十百千廿卅]{{2,}}"
_DIGIT = lambda c: f"translate({c}, '{text.NUMERALS}', '{text.NUMERAL_DIGITS}')"
_UNIT_SQL = "CASE ch WHEN '十' THEN 10 WHEN '百' THEN 100 WHEN '千' THEN 1000 ELSE 0 END"
# a sign is [digit or -1, unit or 0]; the fold holds [total, current]
_FOLD = f"""list_reduce([[0, 0]::BIGINT[]] || list_transform(string_split(tok, ''), lambda ch: [coalesce(try_cast({_DIGIT("ch")} AS BIGINT), -1), {_UNIT_SQL}]::BIGINT[]),
 lambda acc, s: CASE WHEN s[1] >= 0 THEN [acc[1], s[1]] ELSE [acc[1] + greatest(acc[2], 1) * s[2], 0] END)"""
_TENS = " ".join(f"WHEN tok = '{t}' THEN '{v}' WHEN regexp_full_match(tok, '{t}[{text.NUMERALS}]') THEN ({v} + {_DIGIT("substr(tok, 2)")}::INT)::VARCHAR" for t, v in text.TENS.items())
_NUMERAL = f"""CASE WHEN regexp_full_match({_DIGIT("tok")}, '[0-9]+') THEN {_DIGIT("tok")} {_TENS} WHEN regexp_matches(tok, '[廿卅]') THEN tok ELSE list_sum({_FOLD})::BIGINT::VARCHAR END"""


def _numerals_sql(expr: str) -> str:
    """SQL of rows (doc_id, n, v): the expression with its runs of numerals by their values, put together again from the text between them."""
    return f"""s AS (SELECT doc_id, n, {expr} w FROM pc), t AS (SELECT doc_id, n, string_split_regex(w, '{_RUN}') gaps, list_transform(regexp_extract_all(w, '{_RUN}'), lambda tok: {_NUMERAL}) nums FROM s),
v AS (SELECT doc_id, n, array_to_string(flatten(list_transform(range(1, len(gaps) + 1), lambda i: [gaps[i], coalesce(nums[i], '')])), '') v FROM t)"""


def _replaced_sql(expr: str) -> str:
    for old, new in text.REPLACEMENTS:
        expr = f"replace({expr}, '{old}', '{new}')"
    return f"lower({expr})"


_BARE_CJK = _PUNCT_SQL.format(rf"regexp_replace({_CJK_SQL}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g')")


@query(f", {_numerals_sql(_CJK_SQL)} SELECT doc_id, n, v normalized FROM v", p=True)
def normalize_numerals(spark, sf):
    return pieces(spark, sf).select("doc_id", F.col("n").cast("long").alias("n"), text.normalize_numerals(F.translate(F.lower("gt"), LETTERS, SIGNS)).alias("normalized"))


@query(f", {_numerals_sql(f"translate({_BARE_CJK}, '{text.SIMPLIFIED}', '{text.TRADITIONAL}')")} SELECT doc_id, n, {_replaced_sql("v")} normalized FROM v", p=True)
def normalize_full(spark, sf):
    return pieces(spark, sf).select("doc_id", F.col("n").cast("long").alias("n"), text.normalize_full(F.translate(F.lower("gt"), LETTERS, SIGNS)).alias("normalized"))


_WRAPPED = "'[ ' || (doc_id % 9)::VARCHAR || '. ' || gt || ' /abc' || n::VARCHAR || '/ ]'"
_RE_PUNCT = r"[，。！？!?、,.；;：:「」『』“”\"''‘’（）()\[\]【】《》〈〉…~～\-_—]+"


@query(f""" SELECT doc_id, n, regexp_replace(regexp_replace(regexp_replace((doc_id % 9)::VARCHAR || '. ' || gt || ' /abc' || n::VARCHAR || '/', '^[0-9]+[.] *', ''), '/[^/]+/', '', 'g'), '{_RE_PUNCT}| +', '', 'g') clean_gt FROM pc""", p=True)
def clean_reference(spark, sf):
    wrapped = F.concat(F.lit("[ "), (F.col("doc_id") % 9).cast("string"), F.lit(". "), "gt", F.lit(" /abc"), F.col("n").cast("string"), F.lit("/ ]"))
    return pieces(spark, sf).select("doc_id", F.col("n").cast("long").alias("n"), text.clean_reference(wrapped).alias("clean_gt"))


# manifests


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    k, gt = F.col("utt_id") % 13, F.replace(F.col("gt"), F.lit("/"), F.lit(" "))
    made = F.when(k == 0, F.concat(F.lit("1. "), F.lit("why"), F.lit("?"))).when(k == 1, F.lit("ab cd")).when(k == 2, F.lit("...")).when(k == 3, F.concat(F.lit("再講 "), gt)).otherwise(gt)
    rows = utterances(spark, sf).select(
        F.concat(F.lit("spk_"), F.when(F.col("utt_id") % 3 == 0, "HD").when(F.col("utt_id") % 3 == 1, "SCA").otherwise("none")).alias("speaker"), F.col("utt_id").alias("audio_id"),
        made.alias("gt"), F.col("zero_pred").alias("pred"), F.when(k == 4, F.lit(None)).when(k == 5, 0.0).when(k == 6, 0.3).otherwise(F.col("duration")).cast("double").alias("duration"),
        F.col("zero_shot_cer").alias("cer"), F.col("zero_shot_critical").alias("critical"),
    )
    return manifest.classify(rows)


_CLASSIFY_SQL = f""",
c0 AS (SELECT utt_id audio_id, utt_id % 13 k, CASE utt_id % 3 WHEN 0 THEN 'HD' WHEN 1 THEN 'SCA' ELSE 'none' END suffix, replace(gt, '/', ' ') g, zero_shot_cer cer, zero_shot_critical critical,
  CASE utt_id % 13 WHEN 4 THEN NULL WHEN 5 THEN 0.0 WHEN 6 THEN 0.3 ELSE duration END::DOUBLE duration FROM u),
c1 AS (SELECT *, CASE k WHEN 0 THEN '1. why?' WHEN 1 THEN 'ab cd' WHEN 2 THEN '...' WHEN 3 THEN '再講 ' || g ELSE g END gt FROM c0),
c2 AS (SELECT *, regexp_matches(gt, '^ *[\\[(]? *[0-9]+[.):] *.*[?] *[\\])]? *$') question, gt LIKE '%再講%' meta,
  regexp_replace(regexp_replace(regexp_replace(trim(gt), '^ *[\\[(] *(.*?) *[\\])] *$', '\\1'), '^ *[\\[(]? *[0-9]+[.):] *', ''), '{_RE_PUNCT}| +', '', 'g') clean_gt FROM c1),
c3 AS (SELECT *, length(clean_gt) len, NOT question AND length(clean_gt) <= 6 short, clean_gt = '' empty, coalesce(duration <= 0, false) zero FROM c2),
c4 AS (SELECT *, list_sort(list_filter([CASE WHEN question THEN 'prompt_answer_mismatch' END, CASE WHEN short THEN 'short_word_or_isolated_phrase' END, CASE WHEN empty THEN 'empty_clean_gt' END,
   CASE WHEN duration IS NULL THEN 'missing_duration' END, CASE WHEN zero THEN 'duration_zero' END, CASE WHEN duration > 0 AND duration < 0.5 THEN 'duration_very_short' END,
   CASE WHEN duration >= 30 THEN 'duration_very_long' END, CASE WHEN meta THEN 'meta_or_instruction_candidate' END, CASE WHEN critical THEN 'zero_shot_critical' END], lambda x: x IS NOT NULL)) flags,
  list_sort(list_filter([CASE WHEN question THEN 'prompt_answer_mismatch' END, CASE WHEN short THEN 'not_main_read_sentence_task' END, CASE WHEN empty THEN 'empty_clean_gt' END,
   CASE WHEN duration IS NULL THEN 'missing_duration' END, CASE WHEN zero THEN 'duration_zero' END, CASE WHEN meta THEN 'meta_or_instruction_candidate' END], lambda x: x IS NOT NULL)) reasons,
  CASE WHEN question THEN 'open_question_answer' WHEN short THEN 'short_word' WHEN meta THEN 'meta_or_instruction' ELSE 'read_sentence' END task_type FROM c3),
c AS (SELECT *, 'spk_' || suffix || '/' || audio_id::VARCHAR utt, task_type = 'read_sentence' AND len(reasons) = 0 main,
  CASE WHEN suffix = 'none' THEN 'unknown' ELSE suffix END disease_tag,
  CASE WHEN task_type = 'short_word' AND reasons = ['not_main_read_sentence_task'] THEN 'analysis_only' WHEN task_type = 'read_sentence' AND len(reasons) = 0 THEN 'pending' ELSE 'excluded' END split,
  CASE WHEN len(flags) = 0 THEN 'ok' WHEN list_contains(flags, 'prompt_answer_mismatch') THEN 'prompt_answer_mismatch' WHEN list_contains(flags, 'meta_or_instruction_candidate') THEN 'meta_or_instruction_candidate'
   WHEN list_contains(flags, 'duration_zero') OR list_contains(flags, 'empty_clean_gt') THEN 'invalid_for_training' WHEN list_contains(flags, 'short_word_or_isolated_phrase') THEN 'short_word_analysis_only' ELSE 'needs_attention' END quality_label,
  CASE WHEN critical OR cer >= 0.5 THEN 'hard' WHEN cer < 0.2 THEN 'easy' ELSE 'medium' END zero_shot_bucket FROM c4)"""


@query(_CLASSIFY_SQL + """ SELECT utt utt_id, disease_tag, task_type, quality_label, array_to_string(flags, ';') cleaning_flags, array_to_string(reasons, ';') exclusion_reason, main main_train_eligible,
 split, CASE WHEN clean_gt = '' THEN '' ELSE substr(md5(clean_gt), 1, 12) END prompt_id, len::BIGINT clean_gt_char_len FROM c""", u=True)
def classify_manifest(spark, sf):
    return _classified(spark, sf).select(
        "utt_id", "disease_tag", "task_type", "quality_label", F.array_join("cleaning_flags", ";").alias("cleaning_flags"), F.array_join("exclusion_reasons", ";").alias("exclusion_reason"),
        "main_train_eligible", "split", "prompt_id", F.col("clean_gt_char_len").cast("long").alias("clean_gt_char_len"),
    )


@query(_CLASSIFY_SQL + " SELECT tag, count(*) n FROM (SELECT unnest(reasons) tag FROM c) GROUP BY tag", u=True)
def exclusion_reason_counts(spark, sf):
    return summary.tag_counts(_classified(spark, sf), "exclusion_reasons")


@query(_CLASSIFY_SQL + """ SELECT utt utt_id, quality_label, zero_shot_bucket FROM c WHERE quality_label IN ('prompt_answer_mismatch', 'meta_or_instruction_candidate', 'invalid_for_training')
 OR zero_shot_bucket = 'hard' OR coalesce(duration <= 0, false) OR coalesce(duration >= 20, false)""", u=True)
def review_queue(spark, sf):
    return manifest.review_queue(_classified(spark, sf)).select("utt_id", "quality_label", "zero_shot_bucket")


@query(""", d AS (SELECT DISTINCT speaker_id, gt FROM u), o AS (SELECT *, count(*) OVER (PARTITION BY speaker_id) n,
 row_number() OVER (PARTITION BY speaker_id ORDER BY substr(md5(speaker_id || '|' || gt), 1, 12), gt) rn FROM d),
k AS (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) part FROM o)
SELECT speaker_id, gt, CASE WHEN rn <= CASE WHEN n >= 10 THEN part WHEN n >= 4 THEN 1 ELSE 0 END THEN 'test' WHEN rn <= CASE WHEN n >= 10 THEN 2 * part WHEN n >= 4 THEN 1 ELSE 0 END THEN 'dev' ELSE 'train' END split FROM k""", u=True)
def within_speaker_split(spark, sf):
    return manifest.within_speaker_split(utterances(spark, sf), "speaker_id", "gt")


@query(""", r AS (SELECT utt_id, zero_shot_bucket, row_number() OVER (PARTITION BY zero_shot_bucket ORDER BY utt_id) rn, CASE zero_shot_bucket WHEN 'hard' THEN 0 WHEN 'medium' THEN 1 WHEN 'easy' THEN 2 ELSE 3 END b FROM u)
SELECT utt_id, zero_shot_bucket FROM (SELECT * FROM r ORDER BY rn, b LIMIT 32)""", u=True)
def smoke_sample(spark, sf):
    return manifest.stratified_sample(utterances(spark, sf), 32).select("utt_id", "zero_shot_bucket")


@query(" SELECT '/a/' || utt_id::VARCHAR || '.wav' audio, 'language Cantonese<asr_text>' || gt AS text, '' prompt, utt_id, speaker_id, split FROM u WHERE split = 'train' AND gt <> '' AND duration > 0", u=True)
def sft_rows(spark, sf):
    rows = utterances(spark, sf).withColumns({"clean_gt": F.col("gt"), "task_type": F.lit("read_sentence"), "main_train_eligible": F.lit(True), "audio": F.concat(F.lit("/a/"), F.col("utt_id").cast("string"), F.lit(".wav"))})
    return manifest.training_rows(manifest.trainable(rows, "train"))


# comparison


def _three(spark: SparkSession, sf: str) -> DataFrame:
    rows = utterances(spark, sf)
    new = rows.select("utt_id", F.col("new_method_cer").alias("cer"), F.col("new_method_critical").alias("critical"), F.lit(1).alias("position"))
    return compare.three_way(rows.drop("new_method_cer", "new_method_critical"), new)


@query(""" SELECT utt_id, zero_shot_cer, baseline_cer, new_method_cer, new_method_critical, round_even(new_method_cer - baseline_cer, 6) delta_new_vs_baseline_cer,
 round_even(new_method_cer - zero_shot_cer, 6) delta_new_vs_zero_cer FROM u""", u=True)
def three_way_join(spark, sf):
    return _three(spark, sf).select("utt_id", "zero_shot_cer", "baseline_cer", "new_method_cer", "new_method_critical", "delta_new_vs_baseline_cer", "delta_new_vs_zero_cer")


_MEANS = ", ".join(f"round_even(avg({m}_cer), 6) {m}_cer" for m in METHODS)
_DELTAS = "round_even(avg(new_method_cer) - avg(baseline_cer), 6) delta_new_vs_baseline_cer, round_even(avg(new_method_cer) - avg(zero_shot_cer), 6) delta_new_vs_zero_cer"
_RATES = ", ".join(f"round_even(avg({m}_critical::INT), 6) {m}_critical_rate, count_if({m}_critical) {m}_critical_count" for m in METHODS)


@query(f" SELECT {_KIND(DIMS)} group_type, {_VALUE(DIMS)} group_value, count(*) sample_count, {_MEANS}, {_DELTAS}, {_RATES} FROM u GROUP BY {_SETS(DIMS)}", u=True)
def three_way_summary(spark, sf):
    return compare.three_way_summary(_three(spark, sf), DIMS)


@query(f""" SELECT zero_shot_bucket bucket, count(*) sample_count, {_MEANS}, {_DELTAS}, count_if(NOT zero_shot_critical AND baseline_critical) baseline_regressions,
 count_if(NOT zero_shot_critical AND new_method_critical) new_method_regressions FROM u WHERE zero_shot_bucket IN ('hard', 'medium') GROUP BY 1""", u=True)
def focus_metrics(spark, sf):
    return compare.focus_metrics(_three(spark, sf))


@query(f""" SELECT speaker_id, count(*) sample_count, count_if(zero_shot_bucket = 'hard') hard_count, {_MEANS}, round_even(avg(new_method_cer) - avg(baseline_cer), 6) delta_new_vs_baseline_cer,
 count_if(baseline_critical) baseline_critical_count, count_if(new_method_critical) new_method_critical_count, count_if(new_method_critical) - count_if(baseline_critical) delta_critical_count
FROM u GROUP BY 1 ORDER BY delta_new_vs_baseline_cer DESC, delta_critical_count DESC, min(utt_id) LIMIT 10""", u=True)
def worst_speakers_topk(spark, sf):
    return compare.worst_speakers(_three(spark, sf), 10)


_MOVE = lambda m: f"CASE WHEN zero_shot_critical AND NOT {m}_critical THEN 'Rescued' WHEN zero_shot_critical THEN 'Still hard' WHEN {m}_critical THEN 'Regression' ELSE 'Stable easy' END"


@query(f""" SELECT {_MOVE("new_method")} movement_category, count(*) sample_count, round_even(avg(zero_shot_cer), 6) avg_before_cer, round_even(avg(new_method_cer), 6) avg_after_cer,
 round_even(avg(new_method_cer) - avg(zero_shot_cer), 6) avg_delta_cer, count_if(zero_shot_critical) before_critical_count, count_if(new_method_critical) after_critical_count,
 round_even(count(*) / sum(count(*)) OVER (), 6) sample_percent FROM u GROUP BY 1""", u=True)
def error_movement(spark, sf):
    return compare.error_movement(utterances(spark, sf))


@query(f""", m AS (SELECT duration_bucket, {_MOVE("new_method")} c FROM u), k AS (SELECT duration_bucket, count(*) sample_count, count_if(c = 'Rescued') rescued, count_if(c = 'Still hard') still_hard,
 count_if(c = 'Regression') regression, count_if(c = 'Stable easy') stable_easy FROM m GROUP BY 1)
SELECT *, CASE WHEN rescued + still_hard > 0 THEN round_even(rescued / (rescued + still_hard), 6) END rescued_rate, CASE WHEN regression + stable_easy > 0 THEN round_even(regression / (regression + stable_easy), 6) END regression_rate FROM k""", u=True)
def error_movement_by_dim(spark, sf):
    return compare.movement_by(utterances(spark, sf), "duration_bucket")


@query(f""", m AS (SELECT {_MOVE("baseline")} a, {_MOVE("new_method")} b FROM u), k(movement_category) AS (VALUES ('Rescued'), ('Still hard'), ('Regression'), ('Stable easy'))
SELECT *, two_count - one_count delta FROM (SELECT movement_category, (SELECT count(*) FROM m WHERE a = movement_category) one_count, (SELECT count(*) FROM m WHERE b = movement_category) two_count FROM k)""", u=True)
def movement_compare(spark, sf):
    return compare.movement_compare(utterances(spark, sf))


_RUNS = " UNION ALL ".join(f"SELECT '{m}' run, zero_shot_bucket g, {m}_cer c FROM u" for m in METHODS)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("run"), F.col(f"{m}_cer").alias("cer")) for m in METHODS])
    return utterances(spark, sf).select("utt_id", "zero_shot_bucket", F.explode(each).alias("r")).select("utt_id", "zero_shot_bucket", "r.*")


@query(f""", r AS ({_RUNS}) SELECT run, round_even(avg(c) FILTER (g = 'easy'), 6) cer_easy, round_even(avg(c) FILTER (g = 'medium'), 6) cer_medium, round_even(avg(c) FILTER (g = 'hard'), 6) cer_hard FROM r GROUP BY run""", u=True)
def sweep_pivot(spark, sf):
    means = _runs(spark, sf).groupBy("run", F.col("zero_shot_bucket").alias("group")).agg(summary.mean("cer").alias("cer"))
    return compare.sweep_pivot(means, ["easy", "medium", "hard"])


_STEPS = f""", r AS ({_RUNS.replace("zero_shot_bucket g", "utt_id % 10 step")}), s AS (SELECT run, step, round_even(avg(c), 6) cer FROM r GROUP BY ALL)"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).groupBy("run", (F.col("utt_id") % 10).alias("step")).agg(summary.mean("cer").alias("cer"))


@query(_STEPS + " SELECT run, step best_step, cer best_score FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY cer, step) = 1", u=True)
def best_checkpoint(spark, sf):
    return compare.best_checkpoint(_steps(spark, sf))


@query(_STEPS + """, b AS (SELECT *, min(cer) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best_before FROM s)
SELECT *, best_before IS NULL OR cer < best_before improved FROM b""", u=True)
def best_so_far(spark, sf):
    return compare.best_so_far(_steps(spark, sf))


# leakage, components and splits


def _keys(df: DataFrame) -> DataFrame:
    normal = F.regexp_replace(F.lower("gt"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")
    return df.withColumn("normal", normal).withColumn("skeleton", F.translate("normal", "aeiou", ""))


_NORMAL = "regexp_replace(lower(gt), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '', 'g')"
_KEYS = f", t AS (SELECT *, {_NORMAL} normal, translate({_NORMAL}, 'aeiou', '') skeleton FROM u)"
_LAYERED = " UNION ALL ".join(f"SELECT utt_id, split, '{n}' layer, {c} key FROM t" for n, c in LAYERS.items())
_MATCH = f"""{_KEYS}, l AS ({_LAYERED}), tr AS (SELECT layer, key, count(*) n, list_sort(list(utt_id)) ids FROM l WHERE split = 'train' AND key <> '' GROUP BY ALL),
m AS (SELECT utt_id, l.layer, coalesce(n, 0) > 0 seen, coalesce(n, 0) match_count, coalesce(array_to_string(ids[1:20], ';'), '') matched_ids FROM l LEFT JOIN tr ON l.layer = tr.layer AND l.key = tr.key WHERE split = 'test')"""
_ANY = """, a AS (SELECT utt_id, layer, seen FROM m UNION ALL SELECT utt_id, 'any_layer', bool_or(seen) FROM m GROUP BY utt_id)"""


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    rows = _keys(utterances(spark, sf))
    return leakage.match(rows.filter("split = 'test'"), rows.filter("split = 'train'"), LAYERS)


@query(_MATCH + " SELECT * FROM m", u=True)
def leakage_match(spark, sf):
    return _matched(spark, sf)


@query(_MATCH + _ANY + " SELECT layer, count_if(seen) seen_count, count_if(NOT seen) unseen_count, round_even(avg(seen::INT), 6) seen_rate FROM a GROUP BY layer", u=True)
def leakage_summary(spark, sf):
    return leakage.summary(_matched(spark, sf))


@query(_MATCH + _ANY + """, f AS (SELECT layer, seen FROM (SELECT DISTINCT layer FROM a), (VALUES (true), (false)) v(seen)),
g AS (SELECT layer, seen, count(*) n, round_even(avg(zero_shot_cer), 6) z, round_even(avg(new_method_cer), 6) w, count_if(zero_shot_critical) zc, count_if(new_method_critical) wc FROM a JOIN u USING (utt_id) GROUP BY ALL)
SELECT layer, seen, coalesce(n, 0) sample_count, z zero_shot_cer, w new_method_cer, coalesce(zc, 0) zero_shot_critical_count, coalesce(wc, 0) new_method_critical_count FROM f LEFT JOIN g USING (layer, seen)""", u=True)
def seen_unseen_metrics(spark, sf):
    return leakage.seen_unseen_metrics(_matched(spark, sf), utterances(spark, sf), ["zero_shot", "new_method"])


@query(f"""{_KEYS}, l AS ({_LAYERED}), k AS (SELECT layer, key, bool_or(split = 'train') a, bool_or(split = 'dev') b, bool_or(split = 'test') c FROM l GROUP BY ALL)
SELECT layer, count_if(a AND b) train_dev_overlap, count_if(a AND c) train_test_overlap, count_if(b AND c) dev_test_overlap FROM k GROUP BY layer""", u=True)
def overlap_audit(spark, sf):
    return leakage.overlap_audit(_keys(utterances(spark, sf)), LAYERS)


# entries of one to four letters; the longest at a place is read
_LEXICON = {w: f"{w[0]}{len(w)}" for w in "a e i o u n r s t th he in er an re on at en nd ti es or te of the and ing ion tio ent tion ther that ment".split()} | {"ei": "ai2", "ie": "i2", "ss": "s2", "é": "e1", "ü": "u1"}
_READ_SQL = f"""list_transform(regexp_extract_all(lower(gt), '(?s){"|".join(sorted(_LEXICON, key=lambda w: (-len(w), w)))}|.'), lambda w: coalesce(map {{{", ".join(f"'{w}': '{r}'" for w, r in _LEXICON.items())}}}[w], 'UNK:' || w))"""
_READ = f", k AS (SELECT utt_id, split, gt, array_to_string({_READ_SQL}, ' ') reading FROM u)"


def _read(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(_LEXICON.items()), "word string, reading string")
    return readings.with_readings(utterances(spark, sf).select("utt_id", "split", "gt", F.lower("gt").alias("sound"), *more), "sound", lexicon)


@query(_READ + " SELECT utt_id, md5(reading) reading, len(string_split(reading, ' ')) n FROM k", u=True)
def reading_keys(spark, sf):
    return _read(spark, sf).select("utt_id", F.md5("reading").alias("reading"), F.size(F.split("reading", " ")).cast("long").alias("n"))


@query(f""", t AS (SELECT utt_id, array_to_string(list_transform(regexp_extract_all(gt, '(?s){"|".join(sorted(_LEXICON, key=lambda w: (-len(w), w)))}|.'), lambda w: coalesce(map {{{", ".join(f"'{w}': '{r}'" for w, r in _LEXICON.items())}}}[w], w)), '') changed FROM u)
SELECT utt_id, md5(changed) changed FROM t""", u=True)
def phrase_conversion(spark, sf):
    """Phrases of a dictionary in their other form, the longest at each place; all else stays."""
    phrases = spark.createDataFrame(list(_LEXICON.items()), "word string, reading string")
    return readings.with_phrases(utterances(spark, sf).select("utt_id", "gt"), "gt", phrases, "changed").select("utt_id", F.md5("changed").alias("changed"))


@query(_READ + """, l AS (SELECT split, 'raw' layer, gt AS key FROM k UNION ALL SELECT split, 'reading', reading FROM k), m AS (SELECT layer, key, bool_or(split = 'train') a, bool_or(split = 'dev') b, bool_or(split = 'test') c FROM l GROUP BY ALL)
SELECT layer, count_if(a AND b) train_dev_overlap, count_if(a AND c) train_test_overlap, count_if(b AND c) dev_test_overlap FROM m GROUP BY layer""", u=True)
def reading_overlap(spark, sf):
    return leakage.overlap_audit(_read(spark, sf), {"raw": "gt", "reading": "reading"})


@query(_READ + """, w AS (SELECT reading, count(*) n FROM k WHERE split = 'train' AND reading <> '' GROUP BY 1) SELECT utt_id, 'reading' layer, n IS NOT NULL seen, coalesce(n, 0) match_count FROM k LEFT JOIN w USING (reading) WHERE split = 'test'""", u=True)
def reading_leakage(spark, sf):
    rows = Workspace(spark).save(_read(spark, sf), "read")
    return leakage.match(rows.filter("split = 'test'"), rows.filter("split = 'train'"), {"reading": "reading"}).select("utt_id", "layer", "seen", "match_count")


@query(_READ + " SELECT utt_id, min(utt_id) OVER (PARTITION BY reading) comp FROM k", u=True)
def reading_components(spark, sf):
    return components.prompt_components(_read(spark, sf), {"raw": "gt", "reading": "reading"})


_WORDS_SQL = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS_SQL}, ' ') || ' ' t FROM documents), i AS (SELECT item_id, array_to_string({_WORDS_SQL}, ' ') p FROM benchmark WHERE len({_WORDS_SQL}) > 0)
SELECT DISTINCT doc_id, item_id FROM d JOIN i ON contains(t, ' ' || p || ' ')""")
def benchmark_passage_leakage(spark, sf):
    return leakage.passage_containment(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("SELECT min(doc_id) doc_id, md5(text) digest FROM documents GROUP BY text")
def dedupe_first(spark, sf):
    return dedupe.keep_first(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], "doc_id")


@query("SELECT max(doc_id) doc_id, md5(text) digest FROM documents GROUP BY text")
def dedupe_last(spark, sf):
    return dedupe.keep_last(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], "doc_id")


@query("SELECT md5(text) digest, count(*) n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return dedupe.repeated_keys(table(spark, sf, "documents").select(F.md5("text").alias("digest")), "digest")


_DOC_NORMAL = r"regexp_replace(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '', 'g')"
_COMPONENTS = f"""WITH RECURSIVE k AS (SELECT doc_id, md5(text) raw, md5({_DOC_NORMAL}) normalized, md5(translate({_DOC_NORMAL}, 'aeiou', '')) skeleton FROM documents),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY raw) a, min(doc_id) OVER (PARTITION BY normalized) b, min(doc_id) OVER (PARTITION BY skeleton) c FROM k),
e AS (SELECT DISTINCT x, y FROM (SELECT doc_id x, unnest([a, b, c]) y FROM m UNION ALL SELECT unnest([a, b, c]), doc_id FROM m)),
r(node, comp) AS (SELECT doc_id, doc_id FROM k UNION SELECT e.y, r.comp FROM r JOIN e ON e.x = r.node WHERE r.comp < e.y),
comps AS (SELECT node doc_id, min(comp) comp FROM r GROUP BY node)"""


def _text_layers(spark: SparkSession, sf: str) -> DataFrame:
    normal = F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("raw"), F.md5(normal).alias("normalized"), F.md5(F.translate(normal, "aeiou", "")).alias("skeleton"))


_TEXT_LAYERS = {n: n for n in ("raw", "normalized", "skeleton")}


@query(_COMPONENTS + " SELECT doc_id, comp FROM comps")
def prompt_components(spark, sf):
    return components.prompt_components(_text_layers(spark, sf), _TEXT_LAYERS, "doc_id")


_HASHES = ", ".join(f"array_to_string(list_sort(list_transform({n}, lambda v: substr(sha256(v), 1, 16))), ';') {n}_hashes, len({n}) {n}_variants" for n in _TEXT_LAYERS)
_DIGESTS = f"""{_COMPONENTS}, g AS (SELECT comp, count(*) sample_count, {", ".join(f"list_sort(list(DISTINCT {n})) {n}" for n in _TEXT_LAYERS)} FROM comps JOIN k USING (doc_id) GROUP BY comp),
ids AS (SELECT comp, substr(sha256('RAW=' || array_to_string(raw, '||') || chr(10) || 'NORMALIZED=' || array_to_string(normalized, '||') || chr(10) || 'SKELETON=' || array_to_string(skeleton, '||')), 1, 16) prompt_id, sample_count, {_HASHES} FROM g)"""


@query(_DIGESTS + " SELECT * FROM ids")
def component_digests(spark, sf):
    docs = _text_layers(spark, sf)
    return components.component_digests(docs, components.prompt_components(docs, _TEXT_LAYERS, "doc_id"), _TEXT_LAYERS, "doc_id")


@query(_DIGESTS + " SELECT doc_id, prompt_id FROM comps JOIN ids USING (comp)")
def prompt_ids(spark, sf):
    docs = _text_layers(spark, sf)
    comps = Workspace(spark).save(components.prompt_components(docs, _TEXT_LAYERS, "doc_id"), "comps")
    return components.with_prompt_ids(docs, comps, components.component_digests(docs, comps, _TEXT_LAYERS, "doc_id"), "doc_id").select("doc_id", "prompt_id")


@query(""", s AS (SELECT split, count(*) sample_count, count(DISTINCT speaker_id) speaker_count, count_if(zero_shot_bucket = 'easy') zero_easy, count_if(zero_shot_bucket = 'medium') zero_medium,
 count_if(zero_shot_bucket = 'hard') zero_hard, count_if(duration_bucket = 'very_short') duration_very_short, count_if(duration_bucket = 'short') duration_short, count_if(duration_bucket = 'medium') duration_medium,
 count_if(duration_bucket = 'long') duration_long, count_if(duration_bucket = 'very_long') duration_very_long FROM u GROUP BY split) SELECT * FROM s""", u=True)
def split_audit_pivot(spark, sf):
    return splits.split_audit(utterances(spark, sf))


@query(""" SELECT speaker_id, count_if(split = 'train') train, count_if(split = 'dev') dev, count_if(split = 'test') test, arg_min(disease_tag, utt_id) disease_tag,
 least(count_if(split = 'train'), count_if(split = 'dev'), count_if(split = 'test')) > 0 in_all FROM u GROUP BY 1""", u=True)
def speaker_split_crosstab(spark, sf):
    return splits.speaker_crosstab(utterances(spark, sf))


_FIELD = lambda f, w: f"""SELECT sum({w} * abs(coalesce(k, 0) / greatest(n, 1) - al / total)) s FROM (SELECT v, sum(k) al FROM (SELECT {f} v, count(*) k FROM u GROUP BY 1) GROUP BY v) g CROSS JOIN z LEFT JOIN (SELECT {f} v, split, count(*) k FROM u GROUP BY ALL) c USING (v, split)"""


@query(f""", z AS (SELECT split, ratio, count(*) n, count(DISTINCT speaker_id) speakers, count_if(zero_shot_bucket = 'hard') hard, count_if(speaker_id = 'src1') focal, (SELECT count(*) FROM u) total
 FROM u JOIN (VALUES ('train', 0.8::DOUBLE), ('dev', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) r(split, ratio) USING (split) GROUP BY ALL)
SELECT round_even(sum(s), 6) score FROM (SELECT sum(20.0 * abs(n - total * ratio) / greatest(1.0, total * ratio) + CASE WHEN split = 'train' THEN 0 ELSE greatest(0, 25 - speakers) * 1.0 + greatest(0, 35 - hard) * 0.3 + greatest(0, 3 - focal) * 2.0 END) s FROM z
 UNION ALL {_FIELD("zero_shot_bucket", 7.0)} UNION ALL {_FIELD("duration_bucket", 3.0)} UNION ALL {_FIELD("disease_tag", 2.0)})""", u=True)
def split_score(spark, sf):
    return splits.score_split(utterances(spark, sf), (0.8, 0.1, 0.1), "src1").select(metrics.rounded(F.col("score")).alias("score"))


@query()
def split_search(spark, sf):
    return splits.search_split(utterances(spark, sf).withColumn("g", F.concat_ws("/", "speaker_id", "disease_tag")), "g", (0.8, 0.1, 0.1), trials=30_000, focal_speaker="src1")


# audits


@query("SELECT doc_id, 'left_only' side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_set_diff(spark, sf):
    return dedupe.id_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_Q = "round_even(min({0}), 4) min, round_even(quantile_cont({0}, 0.01), 4) p01, round_even(quantile_cont({0}, 0.05), 4) p05, round_even(avg({0}), 4) mean, round_even(quantile_cont({0}, 0.5), 4) median, round_even(quantile_cont({0}, 0.95), 4) p95, round_even(quantile_cont({0}, 0.99), 4) p99, round_even(max({0}), 4) max"


@query(f"SELECT 'price' metric, {_Q.format('l_extendedprice')} FROM lineitem UNION ALL SELECT 'value', {_Q.format('value')} FROM events")
def qa_percentiles(spark, sf):
    one = summary.percentiles(table(spark, sf, "lineitem"), "l_extendedprice", 4).select(F.lit("price").alias("metric"), "*")
    return one.unionByName(summary.percentiles(table(spark, sf, "events"), "value", 4).select(F.lit("value").alias("metric"), "*"))


_ISSUES = """SELECT 'error' severity, 'value_low' code, event_id::VARCHAR AS key, event_type message FROM events WHERE value < 5 UNION ALL
 SELECT 'warning', 'value_high', event_id::VARCHAR, event_type FROM events WHERE value > 50 UNION ALL SELECT 'error', 'bad_type', event_id::VARCHAR, event_type FROM events WHERE event_type = 'error'"""


def _event_issues(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return audit.issues(table(spark, sf, "events"), [audit.Check("error", "value_low", F.col("value") < 5, kind), audit.Check("warning", "value_high", F.col("value") > 50, kind), audit.Check("error", "bad_type", kind == "error", kind)], "event_id")


@query(_ISSUES)
def qa_issues(spark, sf):
    return _event_issues(spark, sf)


@query(f"SELECT severity, code, count(*) n FROM ({_ISSUES}) GROUP BY ALL")
def qa_issue_counts(spark, sf):
    return audit.issue_counts(_event_issues(spark, sf))


@query("""WITH s AS (SELECT count(*) n, count(DISTINCT user_id) users, min(event_type) first_type FROM events)
SELECT 'n' AS key, n::VARCHAR AS value FROM s UNION ALL SELECT 'users', users::VARCHAR FROM s UNION ALL SELECT 'first_type', first_type FROM s""")
def kv_summary(spark, sf):
    return summary.key_values(table(spark, sf, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("event_type").alias("first_type")))


@query("SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def resume_anti_join(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedupe.remaining(table(spark, sf, "orders"), done, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END n_chars, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def right_biased_merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    theirs = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"), "toxic")
    return dedupe.merged(docs, theirs, "doc_id")


@query("""WITH f AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) folder, page_id::VARCHAR || '.wav' AS name, length(html) n FROM pages),
l AS (SELECT folder, name, 'lab ' || n::VARCHAR t FROM f WHERE page_id % 3 = 0), r AS (SELECT folder, name, 'row ' || n::VARCHAR t FROM f WHERE page_id % 2 = 0)
SELECT page_id, coalesce(l.t, r.t, '') gt, CASE WHEN l.t IS NOT NULL THEN '.lab' WHEN r.t IS NOT NULL THEN 'transcript.txt' ELSE '' END gt_source FROM f LEFT JOIN l USING (folder, name) LEFT JOIN r USING (folder, name)""")
def transcript_lookup(spark, sf):
    """Pages stand for audio files: some have a label file, some a row in their folder's table, some both or neither."""
    folder, name = F.regexp_extract("url", "://([^/?#]*)", 1), F.col("page_id").cast("string")
    size = F.length("html").cast("string")
    pages = table(spark, sf, "pages").withColumn("path", F.concat(F.lit("file:/a/"), folder, F.lit("/"), name, F.lit(".wav")))
    lab = pages.filter("page_id % 3 = 0").select(F.concat(F.lit("/a/"), folder, F.lit("/"), name).alias("stem_path"), F.concat(F.lit("lab "), size).alias("text"))
    rows = pages.filter("page_id % 2 = 0").select(F.concat(F.lit("file:///a/"), folder).alias("folder"), F.concat(name, F.lit(".wav")).alias("name"), F.concat(F.lit("row "), size).alias("text"))
    return audio.with_transcripts(pages.select("page_id", "path"), lab, rows).select("page_id", "gt", "gt_source")


@query("""SELECT conv_id, turn, length(text) - lag(length(text)) OVER w delta, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) last_user_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def turn_deltas(spark, sf):
    rows = table(spark, sf, "conversations").withColumns({"size": F.length("text").cast("long"), "user_turn": F.when(F.col("role") == "user", F.col("turn"))})
    order = ["turn", "role", "text"]
    return sequences.fill_forward(sequences.step_differences(rows, "conv_id", order, "size", "delta"), "conv_id", order, "user_turn", "last_user_turn").select("conv_id", "turn", "delta", "last_user_turn")


_RULES = [
    ("o_orderstatus", "O", None, "error"), ("o_totalprice", "150000", 100000.0, "warning"), ("o_shippriority", "0", 0.0, "error"),
    ("o_orderpriority", "5-LOW", None, "warning"), ("o_custkey", "500", 400.5, "error"), ("o_unknown", "x", None, "error"), ("o_missing", None, None, "error"),
]


@query("""WITH r AS (SELECT * FROM (VALUES ('o_orderstatus', 'O', NULL, 'error'), ('o_totalprice', '150000', 100000.0::DOUBLE, 'warning'), ('o_shippriority', '0', 0.0, 'error'), ('o_orderpriority', '5-LOW', NULL, 'warning'),
 ('o_custkey', '500', 400.5, 'error'), ('o_unknown', 'x', NULL, 'error')) v(name, value, tolerance, severity)),
c AS (SELECT o_orderkey, unnest(['o_orderstatus', 'o_totalprice', 'o_shippriority', 'o_orderpriority', 'o_custkey', 'o_unknown']) name,
 unnest([o_orderstatus, o_totalprice::DECIMAL(15, 2)::VARCHAR, (o_orderkey * 0)::VARCHAR, o_orderpriority, o_custkey::VARCHAR, NULL]) cell FROM orders)
SELECT severity, name || '_mismatch' code, o_orderkey::VARCHAR AS key FROM c JOIN r USING (name) WHERE NOT coalesce(CASE WHEN tolerance IS NULL THEN cell = value ELSE abs(try_cast(cell AS DOUBLE) - try_cast(value AS DOUBLE)) <= tolerance END, false)""")
def expectation_rules(spark, sf):
    """Expected values as a table of rules, one of them for a column that is not there."""
    rules = spark.createDataFrame(_RULES, "column string, value string, tolerance double, severity string")
    orders = table(spark, sf, "orders").withColumn("o_shippriority", F.lit(0))
    return audit.expectation_issues(orders, rules, "o_orderkey").select("severity", "code", "key")


# array kernels


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, str, str]:
    df = table(spark, sf, "embeddings")
    vec = next(f.name for f in df.schema if f.dataType.typeName() == "array")
    return df, df.columns[0], vec


@query("""WITH e AS (SELECT a.vec_id, a.embedding x, b.embedding y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
r AS (SELECT vec_id, list_transform(list_zip(x, y), lambda p: p[1]::DOUBLE - p[2]::DOUBLE) d FROM e)
SELECT vec_id, round_even(list_sum(list_transform(d, lambda v: abs(v))) / len(d), 6) l1, round_even(sqrt(list_sum(list_transform(d, lambda v: v * v)) / len(d)), 6) l2 FROM r""")
def vector_residual_stats(spark, sf):
    df, key, vec = _vectors(spark, sf)
    pairs = df.select(key, F.col(vec).alias("x")).join(df.select((F.col(key) - 1).alias(key), F.col(vec).alias("y")), key)
    d = pairs.select(key, residual(F.col("x"), F.col("y")).alias("d"))
    return d.select(key, metrics.rounded(mean_abs(F.col("d"))).alias("l1"), metrics.rounded(root_mean_square(F.col("d"))).alias("l2"))


_FRAMES = "list_transform(range(0, 8), lambda i: list_transform(range(0, 8), lambda k: embedding[i * 8 + k + 1]::DOUBLE))"


def _frames(vec: str):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(vec, i * 8 + 1, 8).cast("array<float>"))


_UNIT = lambda f: f"list_transform({f}, lambda v: v / greatest(sqrt(list_sum(list_transform({f}, lambda q: q * q))), 1e-12))"
_PATHS = f"""WITH RECURSIVE f AS (SELECT vec_id, {_FRAMES} x FROM embeddings),
z0 AS (SELECT vec_id, x, list_transform(range(1, 9), lambda k: list_transform(x, lambda f: f[k])) t FROM f),
z1 AS (SELECT vec_id, x, list_transform(t, lambda v: list_avg(v)) m, list_transform(t, lambda v: greatest(list_stddev_samp(v), 1e-5)) d FROM z0),
z2 AS (SELECT vec_id, x, list_transform(x, lambda f: list_transform(range(1, 9), lambda k: (f[k] - m[k]) / d[k])) z FROM z1),
n AS (SELECT vec_id, x, list_transform(z, lambda f: {_UNIT("f")}) u FROM z2),
c AS (SELECT a.vec_id, list_transform(a.u, lambda p: list_transform(b.u, lambda q: 1 - list_sum(list_transform(range(1, 9), lambda k: p[k] * q[k])))) c FROM n a JOIN n b ON b.vec_id = a.vec_id + 1),
r(vec_id, i, t) AS (SELECT vec_id, 0, [0.0::DOUBLE] || list_transform(range(8), lambda j: 'inf'::DOUBLE) FROM c UNION ALL
 SELECT r.vec_id, i + 1, list_reduce([['inf'::DOUBLE]] || list_transform(range(1, 9), lambda j: [j::DOUBLE]), lambda acc, e: list_append(acc, c[i + 1][e[1]::INT] + least(t[e[1]::INT], t[e[1]::INT + 1], acc[e[1]::INT]))) FROM r JOIN c USING (vec_id) WHERE i < 8),
m AS (SELECT vec_id, list(t ORDER BY i) m FROM r GROUP BY vec_id),
b(vec_id, i, j, back) AS (SELECT vec_id, 8, 8, 0 FROM m UNION ALL SELECT vec_id, CASE WHEN m[i][j] <= least(m[i][j + 1], m[i + 1][j]) OR m[i][j + 1] <= m[i + 1][j] THEN i - 1 ELSE i END,
 CASE WHEN m[i][j] <= least(m[i][j + 1], m[i + 1][j]) OR m[i + 1][j] < m[i][j + 1] THEN j - 1 ELSE j END, back + 1 FROM b JOIN m USING (vec_id) WHERE i > 1 OR j > 1),
path AS (SELECT vec_id, (max(back) OVER (PARTITION BY vec_id) - back)::INT step, i - 1 i, j - 1 j, m[9][9] / count(*) OVER (PARTITION BY vec_id) AS cost FROM b JOIN m USING (vec_id))"""


def _neighbours(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Frames of each embedding as ``x`` and of the next one as ``y``."""
    df, key, vec = _vectors(spark, sf)
    frames = df.select(key, _frames(vec).alias("x"))
    return frames.join(frames.select((F.col(key) - 1).alias(key), F.col("x").alias("y")), key), key


@query(_PATHS + " SELECT vec_id, step, i, j, round_even(cost, 6) cost FROM path")
def dtw_align(spark, sf):
    """Every step of the warping path from each embedding's frames to the next one's."""
    pairs, key = _neighbours(spark, sf)
    return alignment.warping_paths(pairs, key, "x", "y").withColumn("cost", metrics.rounded(F.col("cost")))


@query(_PATHS + """, s AS (SELECT vec_id, i, j FROM path WHERE NOT ((i % 4 = 0 OR i < vec_id % 3) AND vec_id % 2 = 0)), y AS (SELECT vec_id - 1 vec_id, x FROM f),
h AS (SELECT vec_id, i, k, avg(x[j + 1][k]) v FROM s JOIN y USING (vec_id), range(1, 9) b(k) GROUP BY ALL), t AS (SELECT vec_id, x, i, k FROM y JOIN (SELECT DISTINCT vec_id FROM path) USING (vec_id), range(10) a(i), range(1, 9) b(k)),
l AS (SELECT vec_id, i, k, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY vec_id, k ORDER BY i ROWS UNBOUNDED PRECEDING), x[1][k]) v FROM t LEFT JOIN h USING (vec_id, i, k))
SELECT vec_id, i::INT frame, list(round_even(v, 5) + 0.0::DOUBLE ORDER BY k) AS values FROM l GROUP BY ALL""")
def align_frames(spark, sf):
    """The next embedding's frames on a timeline of ten; some paths have holes, at their beginning too."""
    pairs, key = _neighbours(spark, sf)
    work = Workspace(spark)
    paths = work.save(alignment.warping_paths(pairs, key, "x", "y"), "paths").filter(f"NOT ((i % 4 = 0 OR i < {key} % 3) AND {key} % 2 = 0)")
    out = alignment.align_frames(alignment.frame_rows(pairs, key, "y"), paths, pairs.select(key, F.lit(10).alias("length")), key)
    return out.withColumn("values", F.transform("values", lambda v: metrics.rounded(v, 5) + 0.0))


@query(_PATHS + """, y AS (SELECT vec_id - 1 vec_id, x FROM f), h AS (SELECT vec_id, i, k, avg(y.x[j + 1][k]) - any_value(f.x[i + 1][k]) d FROM path JOIN y USING (vec_id) JOIN f USING (vec_id), range(1, 9) b(k) GROUP BY ALL),
s AS (SELECT vec_id, round_even(avg(abs(d)), 6) residual_l1, round_even(sqrt(avg(d * d)), 6) residual_l2 FROM h GROUP BY vec_id), p AS (SELECT vec_id, count(*)::INT path_len, round_even(any_value(cost), 6) cost FROM path GROUP BY vec_id)
SELECT vec_id::VARCHAR vec_id, CASE WHEN vec_id % 3 = 0 THEN 'exists' ELSE 'generated' END status, CASE WHEN vec_id % 3 <> 0 THEN path_len END path_len, CASE WHEN vec_id % 3 <> 0 THEN cost END cost,
 CASE WHEN vec_id % 3 <> 0 THEN residual_l1 END residual_l1, CASE WHEN vec_id % 3 <> 0 THEN residual_l2 END residual_l2 FROM s JOIN p USING (vec_id)""")
def paired_features(spark, sf):
    """Embeddings' frames and the next ones' as pairs; a run over a third of them, and one that does the rest."""
    pairs, key = _neighbours(spark, sf)
    path = _place(spark, "features")
    for part in (pairs.filter(f"{key} % 3 = 0"), pairs):
        out = features.build_features(part, key, "x", "y", path, features=None)
    return out.select(key, "status", "path_len", "cost", "residual_l1", "residual_l2")


_RAGGED = f"r AS (SELECT vec_id, list_slice({_FRAMES}, 1, 1 + (vec_id * 7) % 8) x, 1 + (vec_id * 7) % 8 n FROM embeddings), o AS (SELECT *, row_number() OVER (ORDER BY n, vec_id) - 1 spot FROM r), p AS (SELECT *, spot // 50 batch, max(n) OVER (PARTITION BY spot // 50) longest FROM o)"


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Embeddings as one to eight frames, in padded batches of fifty."""
    df, key, vec = _vectors(spark, sf)
    rows = df.select(key, F.slice(_frames(vec), 1, (1 + (F.col(key) * 7) % 8).cast("int")).alias("x"))
    return batches.padded(batches.length_batches(rows, key, "x", 50), "x", 8), key


@query(f"""WITH {_RAGGED} SELECT vec_id, batch, (spot % 50)::INT place, n n_frames, longest - n padding, list_concat(flatten(x), list_transform(range(8 * (longest - n)), lambda i: 0.0::DOUBLE)) cells,
 list_transform(range(1, longest + 1), lambda i: i <= n) mask FROM p""")
def padded_batches(spark, sf):
    rows, key = _batches(spark, sf)
    return rows.select(key, "batch", "place", "n_frames", "padding", F.flatten("padded").alias("cells"), "mask")


@query(f"""WITH {_RAGGED}, c AS (SELECT batch, n, i, k, x[i][k] a, CASE WHEN i > 1 THEN x[i - 1][k] END b FROM p, range(1, 9) s(i), range(1, 9) t(k) WHERE i <= n)
SELECT batch, round_even(sum(abs(a - (a * 0.5 + 0.25))) / count(*), 6) l1, round_even(coalesce(sum(abs(a - b)), 0) / greatest(count(b), 1), 6) smoothness, count(*) // 8 n_frames, count(b) // 8 n_steps FROM c GROUP BY batch""")
def masked_losses(spark, sf):
    """Losses of padded frames against others; places of padding hold other values and do not count."""
    rows, _ = _batches(spark, sf)
    other = F.transform("padded", lambda f: F.transform(f, lambda v: v * 0.5 + 0.25))
    out = batches.masked_losses(rows.withColumn("y", other), "padded", "y", "mask", "batch")
    return out.withColumns({c: metrics.rounded(F.col(c)) for c in ("l1", "smoothness")})


@query(f"""WITH f AS (SELECT vec_id, {_FRAMES} x FROM embeddings), t AS (SELECT vec_id, x, i, least(greatest((i + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0), 7) spot FROM f, range(12) r(i)),
v AS (SELECT vec_id, i, k, x[floor(spot)::INT + 1][k] + (spot - floor(spot)) * (x[least(floor(spot)::INT + 1, 7) + 1][k] - x[floor(spot)::INT + 1][k]) v FROM t, range(1, 9) s(k))
SELECT vec_id, list(round_even(v, 5) + 0.0::DOUBLE ORDER BY i, k) frames FROM v GROUP BY vec_id""")
def interpolate_frames(spark, sf):
    df, key, vec = _vectors(spark, sf)
    values = F.flatten(interpolate_udf(_frames(vec), F.lit(12)))
    return df.select(key, F.transform(values, lambda v: metrics.rounded(v, 5) + 0.0).alias("frames"))


@query(f"""WITH f AS (SELECT vec_id, {_FRAMES} x FROM embeddings), v AS (SELECT vec_id, i, k, x[i][k] v FROM f, range(1, 9) a(i), range(1, 9) b(k)),
z AS (SELECT vec_id, i, k, (v - avg(v) OVER w) / greatest(stddev_samp(v) OVER w, 1e-5) z FROM v WINDOW w AS (PARTITION BY vec_id, k))
SELECT vec_id, list(round_even(z, 5) + 0.0::DOUBLE ORDER BY i, k) z FROM z GROUP BY vec_id""")
def vector_zscore(spark, sf):
    df, key, vec = _vectors(spark, sf)
    return df.select(key, F.transform(F.flatten(zscore_udf(_frames(vec))), lambda v: metrics.rounded(v, 5) + 0.0).alias("z"))


_BROKEN = """CASE vec_id % 7 WHEN 1 THEN NULL WHEN 2 THEN list_transform(x, lambda f: f[1:7]) WHEN 3 THEN x[1:7] WHEN 4 THEN list_transform(x, lambda f: list_transform(f, lambda v: 'nan'::DOUBLE)) ELSE x END"""


@query(f"""WITH f AS (SELECT vec_id, {_FRAMES} x FROM embeddings), b AS (SELECT vec_id, x, {_BROKEN} y FROM f)
SELECT * FROM (SELECT 'error' severity, 'missing_array' code, vec_id::VARCHAR AS key, 'norm' message FROM b WHERE y IS NULL
UNION ALL SELECT 'error', 'bad_width', vec_id::VARCHAR, 'norm' FROM b WHERE vec_id % 7 = 2 UNION ALL SELECT 'error', 'not_finite', vec_id::VARCHAR, 'norm' FROM b WHERE vec_id % 7 = 4
UNION ALL SELECT 'error', 'unequal_length', vec_id::VARCHAR, 'norm' FROM b WHERE vec_id % 7 = 3
UNION ALL SELECT 'error', 'residual_mismatch', vec_id::VARCHAR, 'residual' FROM b WHERE vec_id % 7 = 4 OR vec_id % 13 = 6 AND vec_id % 7 <> 1
UNION ALL SELECT 'error', 'path_shape', vec_id::VARCHAR, 'x/' || vec_id::VARCHAR || '.pt' FROM b WHERE vec_id % 11 = 5)""")
def vector_audit(spark, sf):
    """Frames of embeddings, some of them broken in one way each, some with a path in the wrong place, some with a residual of another pair."""
    df, key, vec = _vectors(spark, sf)
    x, case = _frames(vec), F.col(key) % 7
    broken = F.when(case == 1, F.lit(None)).when(case == 2, F.transform(x, lambda f: F.slice(f, 1, 7))).when(case == 3, F.slice(x, 1, 7)).when(case == 4, F.transform(x, lambda f: F.transform(f, lambda v: F.lit(float("nan")).cast("float")))).otherwise(x)
    name = F.concat(F.col(key).cast("string"), F.lit(".pt"))
    rest = F.transform(x, lambda f: F.transform(f, lambda v: F.when(F.col(key) % 13 == 6, 0.5).otherwise(0.0)))  # what is left of equal frames is 0
    rows = df.select(key, x.alias("aligned"), broken.alias("norm"), rest.alias("residual"), F.lit("train").alias("split"), F.when(F.col(key) % 11 == 5, F.concat(F.lit("x/"), name)).otherwise(F.concat(F.lit("root/train/"), name)).alias("path"))
    checks = audit.frame_checks({"aligned": 8, "norm": 8, "residual": 8}, ["aligned", "norm"]) + audit.path_checks("path", "split", key, "root")
    return audit.issues(rows, checks, key)


@query()
def log_mel_bins(spark, sf):
    """Embeddings as very short waves: all frames of the log-mel spectrogram."""
    df, key, vec = _vectors(spark, sf)
    frames = log_mel_udf(F.flatten(F.array_repeat(F.col(vec).cast("array<double>"), 10)))
    return df.select(key, F.posexplode(frames).alias("frame", "v")).select(key, "frame", F.transform("v", lambda v: metrics.rounded(v, 3)).alias("bins"))


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) x FROM embeddings), s AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) rms, list_max(list_transform(x, lambda v: abs(v))) top FROM w),
g AS (SELECT *, pow(10::DOUBLE, (-23.0 - 20 * log10(rms)) / 20) gain FROM s)
SELECT vec_id, round_even(20 * log10(greatest(rms, 1e-12)), 4) dbfs, round_even(top, 6) peak, round_even(top * CASE WHEN top * gain > 0.99 THEN 0.99 / top ELSE gain END, 4) scaled_peak FROM g""")
def loudness_levels(spark, sf):
    df, key, vec = _vectors(spark, sf)
    wave = F.col(vec).cast("array<double>")
    rows = df.select(key, wave.alias("x"), audio.normalize_loudness(wave).alias("y"))
    return rows.select(
        key, metrics.rounded(metrics.dbfs(metrics.mean_square(F.col("x"))), 4).alias("dbfs"), metrics.rounded(metrics.peak(F.col("x")), 6).alias("peak"),
        metrics.rounded(metrics.peak(F.col("y")), 4).alias("scaled_peak"),
    )


# sources and sinks, as round trips through the shared folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR doc_id, text, lang, '' missing FROM documents")
def csv_round_trip(spark, sf):
    path, columns = _place(spark, "csv"), ["doc_id", "text", "lang", "missing"]
    tables.write_csv(table(spark, sf, "documents"), path, columns)
    return tables.read_csv(spark, path, columns)


@query("""WITH a AS (SELECT doc_id::VARCHAR id, 'one' AS file FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id::VARCHAR id, 'two' AS file FROM documents WHERE doc_id % 2 = 0)
SELECT id, file, false repeated FROM a UNION ALL SELECT id, file, false FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, '', true FROM b WHERE id IN (SELECT id FROM a)""")
def csv_union_first(spark, sf):
    """Two files that share ids: the first file's rows, what the second adds, and the ids left out."""
    docs, paths = table(spark, sf, "documents"), []
    for name, part in (("one", docs.filter("doc_id % 3 = 0")), ("two", docs.filter("doc_id % 2 = 0"))):
        paths.append(_place(spark, f"csv-{name}"))
        tables.write_csv(part.select(F.col("doc_id").alias("id"), F.lit(name).alias("file")), paths[-1], ["id", "file"], strict=True)
    rows, repeated = tables.read_csvs(spark, paths, ["id", "file"], "id")
    return rows.withColumn("repeated", F.lit(False)).unionByName(repeated.select("id", F.lit("").alias("file"), F.lit(True).alias("repeated")))


@query("SELECT conv_id, turn, role, text, count(*) OVER () lines FROM conversations")
def jsonl_round_trip(spark, sf):
    path, rows = _place(spark, "jsonl"), table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tables.write_jsonl(rows, path)
    lines = tables.count_lines(spark, path)
    return tables.read_jsonl(spark, path, rows.schema, required=["conv_id", "turn"]).withColumn("lines", F.lit(lines).cast("long"))


@query("SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'third' WHEN doc_id % 4 = 0 THEN 'again' ELSE 'once' END state FROM documents")
def jsonl_cache_last(spark, sf):
    """A log that three runs append to: the last line of each key counts, whatever the files are called."""
    path, docs = _place(spark, "log"), table(spark, sf, "documents").select("doc_id")
    for every, state in ((1, "once"), (4, "again"), (12, "third")):
        tables.append_jsonl(docs.filter(f"doc_id % {every} = 0").withColumn("state", F.lit(state)), path)
    return tables.read_jsonl_cache(spark, path, "doc_id long, state string", "doc_id")


@query("SELECT doc_id, md5(text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END) digest, (doc_id % 3 = 0)::BIGINT n_bad FROM documents")
def staged_rewrite(spark, sf):
    """Lines of which some hold a byte that is no UTF-8: read, scored and published as the next version."""
    path, docs = _place(spark, "staged"), table(spark, sf, "documents").select("doc_id", "text")
    line = F.to_json(F.struct("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "#BAD#").otherwise("")).alias("text")))
    staged.publish_lines(docs.select(F.replace(line, F.lit("#BAD#"), F.unhex(F.lit("FF")).cast("string")).alias("value")), path)
    bad = F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))
    staged.rewrite(spark, path, "doc_id long, text string", lambda rows: rows.withColumn("n_bad", bad.cast("long")))
    return staged.current(spark, path, "doc_id long, text string, n_bad long").select("doc_id", F.md5("text").alias("digest"), "n_bad")


@query("SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'validation' END split FROM documents")
def json_split_dict(spark, sf):
    docs, paths = table(spark, sf, "documents").select("doc_id"), {}
    for name, rule in (("train", "doc_id % 10 < 8"), ("validation", "doc_id % 10 >= 8")):
        paths[name] = _place(spark, name)
        tables.write_jsonl(docs.filter(rule), paths[name])
    return tables.read_splits(spark, paths, "doc_id long")


@query("SELECT lang, source, count(*) n FROM documents GROUP BY ALL")
def partitioned_payloads(spark, sf):
    path = _place(spark, "payloads")
    tables.write_partitioned(table(spark, sf, "documents"), path, "lang", "source")
    return spark.read.parquet(path).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""SELECT vec_id::VARCHAR AS key, 'load_error' code, 'payload is absent' message FROM embeddings WHERE vec_id % 5 = 0
UNION ALL SELECT vec_id::VARCHAR, 'missing_array', 'aligned' FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 = 0 UNION ALL SELECT vec_id::VARCHAR, 'missing_array', 'residual' FROM embeddings WHERE vec_id % 5 <> 0""")
def payload_issues(spark, sf):
    """Payloads of which some are absent, some lack an array, and all lack another."""
    df, key, vec = _vectors(spark, sf)
    path = _place(spark, "frames")
    df.filter(f"{key} % 5 <> 0").select(key, F.when(F.col(key) % 3 != 0, F.col(vec)).alias("aligned")).write.parquet(path)
    return tables.load_payloads(spark, path, df.select(key), key, ["aligned", "residual"])[1]


@query("SELECT 'checkpoint-' || o_orderkey::VARCHAR AS path, o_orderkey step, o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) keep FROM orders")
def checkpoint_retention(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("r").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("cer"))
    paths = orders.select(F.concat(F.lit("checkpoint-"), F.col("step").cast("string")).alias("path"))
    return audio.retention(paths, compare.best_checkpoint(orders))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) row_no, printf('test_%04d', row_number() OVER (ORDER BY o_totalprice, o_orderkey)) sample_key FROM orders")
def numbered_rows(spark, sf):
    return dedupe.numbered(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_no", "sample_key")


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS index FROM (SELECT DISTINCT p_brand FROM part)")
def vocabulary_index(spark, sf):
    return summary.vocabulary(table(spark, sf, "part"), "p_brand")


@query("SELECT doc_id, md5(text) digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def later_copies(spark, sf):
    return dedupe.later_duplicates(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], "doc_id")


@query("SELECT round_even(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) l_discount, round_even(sum(l_tax * l_quantity) / greatest(sum(l_quantity), 1), 6) l_tax FROM lineitem")
def frame_weighted_means(spark, sf):
    rows = table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return summary.weighted_means(rows, "l_quantity", "l_discount", "l_tax")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_rows(spark, sf):
    return sampling.longest(table(spark, sf, "documents"), 25, "n_chars", "doc_id").select("doc_id", "n_chars")


@query("""SELECT utt_id::VARCHAR utt_id, speaker_id patient_id, gt clean_text, '' jyutping, '/a/' || utt_id::VARCHAR || '.wav' dys_wav_path, '/tts/' || split || '/' || utt_id::VARCHAR || '.wav' norm_wav_path, split,
 '' prompt_id, zero_shot_bucket, utt_id::VARCHAR duration, '' source_manifest FROM u""", u=True)
def pair_manifest(spark, sf):
    rows = utterances(spark, sf).withColumns({"clean_gt": F.col("gt"), "audio": F.concat(F.lit("/a/"), F.col("utt_id").cast("string"), F.lit(".wav")), "duration": F.col("utt_id")})
    return manifest.pair_rows(rows, "/tts")


@query("""SELECT conv_id, turn, 'role ' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE role END || ':' prefix_text, CASE WHEN conv_id % 3 = 0 THEN '' ELSE role END prompt, '/a' audio, text target FROM conversations""")
def chat_prefix_rows(spark, sf):
    """Turns of conversations with their role for a prompt, which a third of the conversations lacks."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("prompt"), F.lit("/a").alias("audio"), "text")
    return manifest.prefix_rows(rows, lambda prompt: F.concat(F.lit("role "), prompt, F.lit(":")), "conv_id", "turn")


@query(f""", r AS (SELECT utt_id, lower(replace(gt, ' ', '')) a, lower(replace(new_pred, ' ', '')) b, new_pred FROM u), d AS (SELECT *, {distance("a", "b")}::DOUBLE / greatest(length(a), 1) rate FROM r)
SELECT utt_id, round_even(rate, 6) cer, trim(new_pred) = '' OR round_even(rate, 6) >= 0.5 critical, CASE WHEN trim(new_pred) = '' THEN 'blank_prediction' WHEN round_even(rate, 6) >= 0.5 THEN 'textnorm_cer>=0.5' ELSE '' END reason FROM d""", u=True)
def scored_rows(spark, sf):
    return metrics.score_row(utterances(spark, sf), pred="new_pred", normalise=text.normalize_degraded).select("utt_id", "cer", "critical", "reason")


_SPARSE = "CASE WHEN utt_id % 7 = 0 THEN NULL ELSE {0} END"


@query(f""", s AS (SELECT duration_bucket, CASE WHEN utt_id % 5 = 0 THEN NULL WHEN utt_id % 5 = 1 THEN 'nan'::DOUBLE WHEN duration_bucket = 'short' THEN pow(2, 90) WHEN duration_bucket = 'medium' THEN 'inf'::DOUBLE ELSE zero_shot_cer END z, new_method_cer w, {_SPARSE.format("zero_shot_critical")} zc, new_method_critical wc FROM u),
a AS (SELECT duration_bucket, count(*) sample_count, avg(z) FILTER (NOT isnan(z)) z, avg(w) w, avg(zc::INT) zc, avg(wc::INT) wc, count_if(zc) zn, count_if(wc) wn FROM s GROUP BY GROUPING SETS ((), (duration_bucket)))
SELECT coalesce('duration_bucket=' || duration_bucket, 'overall') "group", sample_count, round_even(z, 6) before_cer, round_even(w, 6) after_cer, round_even(w - z, 6) delta_cer, round_even(zc, 6) before_critical_rate,
 round_even(wc, 6) after_critical_rate, round_even(wc - zc, 6) delta_critical_rate, zn before_critical_count, wn after_critical_count FROM a""", u=True)
def stratified_summary_with_gaps(spark, sf):
    """Blank and NaN rates and blank flags, which the summary leaves out; infinite and very large rates, which it does not."""
    case, bucket = F.col("utt_id") % 5, F.col("duration_bucket")
    large = F.when(bucket == "short", F.lit(2.0**90)).when(bucket == "medium", F.lit(float("inf")))
    rows = utterances(spark, sf).withColumns({
        "z": F.when(case == 0, F.lit(None)).when(case == 1, F.lit(float("nan"))).otherwise(F.coalesce(large, F.col("zero_shot_cer"))), "zc": F.when(F.col("utt_id") % 7 != 0, F.col("zero_shot_critical")),
    })
    return summary.stratified_summary(rows, ["duration_bucket"], ("z", "zc"), ("new_method_cer", "new_method_critical"))


@query(f""", s AS (SELECT nullif(duration_bucket, 'short') g, CASE WHEN utt_id % 5 = 1 THEN 'nan'::DOUBLE ELSE zero_shot_cer END z, baseline_cer b, new_method_cer w, coalesce({_SPARSE.format("zero_shot_critical")}, false) zc, baseline_critical bc, new_method_critical wc FROM u),
a AS (SELECT g, grouping(g) k, count(*) n, avg(z) FILTER (NOT isnan(z)) z, avg(b) b, avg(w) w, avg(zc::INT) zr, avg(bc::INT) br, avg(wc::INT) wr, count_if(zc) zn, count_if(bc) bn, count_if(wc) wn FROM s GROUP BY GROUPING SETS ((), (g)))
SELECT CASE WHEN k = 1 THEN 'overall' ELSE 'g' END group_type, CASE WHEN k = 1 THEN 'all' ELSE g END group_value, n sample_count, round_even(z, 6) zero_shot_cer, round_even(b, 6) baseline_cer, round_even(w, 6) new_method_cer,
 round_even(w - b, 6) delta_new_vs_baseline_cer, round_even(w - z, 6) delta_new_vs_zero_cer, round_even(zr, 6) zero_shot_critical_rate, round_even(br, 6) baseline_critical_rate, round_even(wr, 6) new_method_critical_rate,
 zn zero_shot_critical_count, bn baseline_critical_count, wn new_method_critical_count FROM a WHERE k = 1 OR g IS NOT NULL""", u=True)
def three_way_summary_with_gaps(spark, sf):
    """NaN rates are in no mean, blank flags count as false, and blank groups are none."""
    rows = utterances(spark, sf).withColumns({
        "g": F.nullif("duration_bucket", F.lit("short")), "zero_shot_cer": F.when(F.col("utt_id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("zero_shot_cer")),
        "zero_shot_critical": F.when(F.col("utt_id") % 7 != 0, F.col("zero_shot_critical")),
    })
    return compare.three_way_summary(rows, ["g"])


# inference and streams


class FakeTranscriber:
    """Puts x for e; fails on texts with a percent sign or a plus."""

    def transcribe(self, inputs: list[str]) -> list[str]:
        if any("%" in x or "+" in x for x in inputs):
            raise ValueError("bad sign")
        return [x.replace("e", "x") for x in inputs]


class FakeModel:
    """Two frames for a text, and its bytes as audio; fails on an empty text."""

    def embed(self, inputs: list[str]) -> list[list[list[float]]]:
        return [[[float(len(x)), float(x.count("e"))], [float(x.count(" ")), 1.0]] for x in inputs]

    def speak(self, words: str) -> bytes:
        if words.startswith("A"):
            raise RuntimeError("no voice")
        return words.encode()


@query(""" SELECT utt_id::VARCHAR utt_id, replace(gt, 'e', 'x') pred FROM u WHERE NOT regexp_matches(gt, '[%+]')""", u=True)
def infer_fake(spark, sf):
    return infer.infer_or_fail(utterances(spark, sf).filter("NOT gt RLIKE '[%+]'"), FakeTranscriber, key="utt_id", source="gt")


@query(""" SELECT utt_id::VARCHAR utt_id, [[length(gt), length(gt) - length(replace(gt, 'e', ''))]::DOUBLE[], [length(gt) - length(replace(gt, ' ', '')), 1]::DOUBLE[]] frames FROM u""", u=True)
def extract_frames_fake(spark, sf):
    return infer.extract_frames(utterances(spark, sf), FakeModel, key="utt_id", source="gt")


@query(""" SELECT utt_id::VARCHAR utt_id, CASE WHEN utt_id % 3 = 0 THEN 'exists' WHEN gt LIKE 'A%' THEN 'error' ELSE 'generated' END status, CASE WHEN utt_id % 3 <> 0 AND gt NOT LIKE 'A%' THEN octet_length(encode(gt)) END::BIGINT size,
 CASE WHEN utt_id % 3 <> 0 AND gt LIKE 'A%' THEN 'RuntimeError: no voice' ELSE '' END error FROM u""", u=True)
def synthesize_fake(spark, sf):
    rows = utterances(spark, sf)
    done = infer.synthesize(rows, rows.filter("utt_id % 3 = 0"), FakeModel, key="utt_id", text="gt")
    return done.select("utt_id", "status", F.octet_length("audio").cast("long").alias("size"), "error")


@query(""" SELECT utt_id::VARCHAR utt_id, CASE WHEN regexp_matches(gt, '[%+]') THEN '' ELSE replace(gt, 'e', 'x') END pred, CASE WHEN regexp_matches(gt, '[%+]') THEN 'ValueError: bad sign' ELSE '' END inference_error FROM u""", u=True)
def batch_infer_fake(spark, sf):
    return infer.batch_infer(utterances(spark, sf), FakeTranscriber, key="utt_id", source="gt").select("utt_id", "pred", "inference_error")


@query("SELECT date_trunc('hour', ts) window_start, event_type, count(*) n, round_even(sum(value), 4) total FROM events GROUP BY ALL")
def streaming_window(spark, sf):
    return windows.tumbling(table(spark, sf, "events"))


@query(f"""WITH half AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 mid FROM events), e AS (SELECT *, date_trunc('hour', ts) w, ts < mid AND event_id % 97 <> 0 early FROM events, half),
wm AS (SELECT max(ts) - INTERVAL 2 HOUR wm FROM e WHERE early)
SELECT w window_start, event_type, count(*) n, round_even(sum(value), 4) total FROM e, wm WHERE early OR w + INTERVAL 1 HOUR > date_trunc('millisecond', wm) GROUP BY ALL""")
def streaming_restart(spark, sf):
    """Events as a stream that stops at half time and goes on from its checkpoint; events held back until then, whose windows have closed, are late."""
    root, events = _place(spark, "stream"), table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    early = (F.col("ts") < F.lit(ends["a"] + (ends["z"] - ends["a"]) / 2)) & (F.col("event_id") % 97 != 0)
    for part in (events.filter(early), events.filter(~early)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = windows.read_stream(spark, f"{root}/in", events.schema)
        windows.run_windows(stream, f"{root}/out", f"{root}/checkpoint")
    return windows.latest_windows(spark, f"{root}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) prev FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) g FROM o)
SELECT user_id, min(ts) session_start, max(ts) + INTERVAL 30 MINUTE session_end, count(*) n FROM s GROUP BY user_id, g""")
def streaming_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"))


@query()
def seeded_sample(spark, sf):
    return sampling.driver_shuffle(table(spark, sf, "events"), 50, "event_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY md5('7|' || event_id::VARCHAR), event_id LIMIT 50")
def hashed_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "events"), 50, "event_id").select("event_id", "user_id")


@query(""", e AS (SELECT split, unnest([min(utt_id), max(utt_id)]) utt_id FROM u GROUP BY split), r AS (SELECT DISTINCT utt_id, split, (utt_id, split) NOT IN (SELECT (utt_id, split) FROM e) rest FROM u)
SELECT utt_id, split FROM r ORDER BY rest, md5('7|' || utt_id::VARCHAR), utt_id LIMIT 30""", u=True)
def edges_and_sample(spark, sf):
    rows = utterances(spark, sf).select("utt_id", "split")
    return sampling.edges_and_sample(rows, 30, "utt_id")


@query(""", r AS (SELECT utt_id, split, speaker_id, CASE zero_shot_bucket WHEN 'hard' THEN 1 WHEN 'medium' THEN 2 WHEN 'easy' THEN 3 ELSE 99 END k, md5('7|' || utt_id::VARCHAR) h FROM u WHERE utt_id % 4 <> 0),
t AS (SELECT *, row_number() OVER (PARTITION BY split, speaker_id ORDER BY k, h, utt_id) turn FROM r)
SELECT utt_id, split, speaker_id FROM t QUALIFY row_number() OVER (PARTITION BY split ORDER BY turn, k, h, utt_id) <= 5""", u=True)
def demo_pick(spark, sf):
    return sampling.pick_demo(utterances(spark, sf), 5, usable=F.col("utt_id") % 4 != 0).select("utt_id", "split", "speaker_id")


@query("""SELECT * FROM (VALUES ('a_HD/s1/u1.wav', 'a_HD', 's1', 'u1', 1.0::DOUBLE, NULL), ('a_HD/s1/u2.wav', 'a_HD', 's1', 'u2', 0.25::DOUBLE, NULL),
 ('b/u3.wav', 'b', '', 'u3', NULL, 'ValueError: not a RIFF/WAVE file')) v(rel_path, speaker, session, audio_id, duration_sec, error)""")
def fs_manifest_scan(spark, sf):
    """Writes small files of speech-like names and reads their headers back."""
    from talus.sources.sample import write_sample_tree

    root = _place(spark, "audio")
    write_sample_tree(spark, root)
    files = audio.discover(spark, root).withColumn("h", audio.wav_header("content"))
    return files.select("rel_path", "speaker", "session", "audio_id", "h.duration_sec", "h.error")

"""The pipeline's stages on planted cases and against brute force."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_llm import sentence

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, root = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    passage = sentence(rng, 60)
    item = sentence(rng, 25)
    for i in range(240):
        t = "\n".join(sentence(rng, rng.randrange(15, 40)) for _ in range(3))
        if i % 6 == 0:
            t += " grobian" + rng.choice("abcdef") + " grobian" + rng.choice("ghijk")
        if i in (31, 61):
            t += "\n" + passage
        if i == 91:
            t += " " + item
        docs.append((i, t))
        labels.append((i, 1, int(i % 6 == 0)))
    w = docs[1][1].split()
    docs += [(300, docs[1][1]), (301, " ".join([*w[:-1], "changed"])), (302, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = f"{sf}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        kept[name] = (before, after)
    before, after = kept["toxicity"]
    toxic = {d for d in before if d < 240 and d % 6 == 0}
    assert len(toxic & set(after)) <= 2 and len(set(before) - set(after) - toxic) <= 2
    before, after = kept["line_dedup"]
    wanted = {d: t for d, (lines, n, t) in brute.line_dedup(list(before.items()), 50).items() if not (n and n == lines)}
    assert after == wanted and 300 not in after and after[61] != before[61]
    before, after = kept["near_dedup"]
    assert set(after) == {d for d, r in brute.near_duplicates(list(before.items()), 5, 80).items() if r[2]} and 301 not in after
    before, after = kept["decontamination"]
    item = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {d for d, r in brute.contamination(list(before.items()), item).items() if r[4]} == {91}


PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_run(spark, sf):
    """The whole run against its stages one by one, and the pieces against the documents that the stages keep."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{sf}/run-{k}")
        docs = spark.read.parquet(f"{sf}/run-{k}")
    out = pipeline.run(spark, sf)
    rows = out.collect()
    assert out.columns == PACKED and {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    for d in {r["doc_id"] for r in rows}:
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == d)
        assert mine[0][0] == 0 and sum(n for _, n, _ in mine) == mine[0][2]


def test_rows_stand_by_their_own_text(spark, sf, tmp_path):
    """Null ids, ids that occur twice, null and empty texts, repeated rows, and columns named like inner ones."""
    bad, item = "grobianax grobianbj grobianc", spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rng = random.Random(5)
    t = [sentence(rng, 60) for _ in range(6)]
    rows = [(None, f"{t[0]} {bad}"), (None, t[0]), (5, f"{t[1]} {item}"), (5, t[1]), (6, None), (7, ""), (8, t[2]), (8, t[2]), (None, t[2] + " more"), (9, "  \n "), (10, t[3])]
    made = [(d, x, "en", None, len(x or ""), "k", False, "p") for d, x in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, key string, kept boolean, p0 string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    at = str(tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    rest = lambda *gone: sorted((d or 0, x or "") for k, (d, x) in enumerate(rows) if k not in gone)
    assert left(pipeline.near_dedup(spark, docs, at)) == rest(8)
    assert left(pipeline.decontamination(spark, docs, at)) == rest(2)
    assert left(pipeline.line_dedup(spark, docs, at)) == rest()
    assert pipeline.toxicity(spark, docs, at).columns == docs.columns
    none = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, none, at)
        assert out.count() == 0 and out.columns == docs.columns
    assert pipeline.packing(spark, none, at).count() == 0 and pipeline.packing(spark, docs, at).filter("length = 1").count() == 2

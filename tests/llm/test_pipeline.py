"""The pipeline's stages against brute force over a small corpus."""

import re
from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest

from kgloom.llm import packing
from kgloom.llm.common import BATCH_BYTES


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, spark, corpus):
    d = str(tmp_path_factory.mktemp("sf"))
    corpus.drop("quality_note").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_run_equals_stages(spark, sf_dir, corpus):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = f(spark, docs, sf_dir)
        assert docs.columns == columns, name
        if name == "n-gram Jaccard join":
            sets = {}
            for r in before.where("doc_id IS NOT NULL").collect():
                w = (r.text or "").encode().lower().split()
                sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            kept = {r.doc_id for r in docs.collect()}
            for a in kept - {None}:
                assert not any(b < a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in kept - {None})
            assert {a for a in sets if not sets[a]} <= kept
    got = corpus_pipeline.run(spark, sf_dir)
    assert sum(r.length for r in got.collect()) == sum(r.length for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect())


def test_short_lines_are_deduplicated_too(spark):
    texts = ["Les.\nla la la la la la\none two three four\n\nends here", "les.\nnew\nla la\none two three\n\nfour three two one", "這是一行沒有空白的文字", "這是一行沒有空白的文字", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: "new\none two three\n", 2: texts[2], 3: "", 4: None}


def test_arrow_batches_are_bounded_in_bytes(spark, sf_dir):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(64).coalesce(1).selectExpr("id AS doc_id", "repeat('some words ', 20000) AS text", "'s' AS source")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for step in (lambda: packing.pack(texts.limit(1)), lambda: corpus_pipeline.classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)):
        spark.conf.unset(name)
        step()
        seen = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
        assert sum(seen) > 64 * 220_000 and max(seen) <= BATCH_BYTES + 300_000

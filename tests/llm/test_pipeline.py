import hashlib

import numpy as np
import pytest

import corpus_pipeline
from listingmill.llm import common, exact_dedup, mixing, quality, queries, simhash_dedup


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    scores = quality.score(docs, quality.fit(docs, labels)).collect()
    kept = {r.doc_id for r in scores if r.predicted == 1}
    first = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.exact_stage(spark, first, sf_dir)
    by_text = {}
    for i in kept:
        by_text.setdefault(text[i], []).append(i)
    unique = {max(v) for v in by_text.values()}
    assert {r.doc_id for r in second.collect()} == unique
    third = corpus_pipeline.near_stage(spark, second, sf_dir)
    near = {r.doc_id: r for r in simhash_dedup.near_duplicates(second).collect()}
    prints = {i: int(near[i].fingerprint, 16) for i in unique}
    stays = {r.doc_id for r in third.collect()}
    # every document that went is linked to another, and of those that stay no two are linked
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 4 for j in unique if j != i) for i in unique - stays)
    assert not any((prints[i] ^ prints[j]).bit_count() <= 4 for i in stays for j in stays if i < j)
    fourth = corpus_pipeline.mixing_stage(spark, third, sf_dir)
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in mixing.mix_sources(third).where("sampled").collect()}
    assert exact_dedup.exact_duplicates(fourth).where("NOT kept").count() == 0
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in fourth.collect()}
    assert set(last.columns) >= {"doc_id", "n_tokens", "ids"}


def test_last_stage_encodes_and_decodes(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary())
    texts = ["", "Hello  world's END", "naïve — 12.5 %\n日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "BPE encoding and decoding"
    rows = {r.doc_id: r for r in stage(spark, docs, "").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert rows[i].decoded_sha256 == hashlib.sha256(rows[i].decoded.encode()).hexdigest()


@pytest.mark.parametrize("bound", [common.BROADCAST_ROWS, 0])
def test_stages_on_odd_rows(spark, sf_dir, odd, monkeypatch, bound):
    """Nulls, blanks, repeated ids and rows, very long texts, clashing columns: one row stays of each group."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    kinds = "doc_id long, text string, source string, lang string, _row int, n int"
    rows = [(1, "same text here", "src1", "en", 1, 0), (1, "same text here", "src1", "en", 1, 0), (1, "another text", None, None, 2, 0), (None, "same text here", "src1", "en", 3, 0), (None, None, None, "en", 4, 0), (None, "", "x", "de", 5, 0), (2, "long " * 300_000, "src2", "fr", 6, 0)]
    docs = spark.createDataFrame(rows, kinds)
    exact = corpus_pipeline.exact_stage(spark, docs, sf_dir)
    assert exact.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:12]) for r in exact.collect()) == [(0, ""), (1, "another text"), (1, "same text he"), (2, "long long lo")]
    near = corpus_pipeline.near_stage(spark, docs, sf_dir)
    assert sorted((r.doc_id or 0, (r.text or "")[:12]) for r in near.collect()) == [(0, ""), (1, "another text"), (1, "same text he"), (2, "long long lo")]
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.count() == quality.score(docs, model).where("predicted = 1").count() and good.columns == docs.columns
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    assert mixed.count() == mixing.mix_sources(docs).where("sampled").count() and mixed.columns == docs.columns
    assert corpus_pipeline.bpe_stage(spark, docs, sf_dir).count() == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_clean_texts_move_in_no_join_of_filters(spark, sf_dir):
    """Rejected and sampled rows are decided where they lie."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.mixing_stage):
        plan = stage(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan

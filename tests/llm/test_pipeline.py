"""The pipeline: what each stage takes out, and what it leaves alone."""

from __future__ import annotations

import pytest

pytest.importorskip("quiverlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_llm import ODD, docs, labelled, prose  # noqa: E402


def test_run(spark, tmp_path):
    d, labels, _ = labelled(spark, 300)
    passage = prose(901, 70)
    near = prose(902, 400).split()
    extra = [(5000, prose(900, 90)), (5001, prose(900, 90)), (5002, " ".join(near)), (5003, " ".join([*near[:200], "other", *near[201:]])), (5004, f"{passage} {prose(903, 40)}"), (5005, f"{prose(904, 40)} {passage}"), (5006, prose(905, 60) + " vile filth rotten")]
    base = d.where("doc_id > 12").select("doc_id", "text", "lang", "source", "n_chars")
    documents = base.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], base.schema))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert now.columns == base.columns
    assert 5006 not in seen["toxicity"] and {5000, 5001, 5004} <= seen["toxicity"]
    assert 5001 in seen["exact_dedup"] and 5000 not in seen["exact_dedup"]
    assert {5002, 5003} & seen["simhash_near_dedup"] == {5002}
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "substring_dedup")).collect()}
    assert passage in text[5004] and passage not in text[5005] and prose(904, 40) in text[5005]
    assert seen["best_fit_packing"] == seen["substring_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and a very long text; then an empty table."""
    _, labels, _ = labelled(spark, 300)
    rows = docs(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for name, d in (("odd", rows), ("empty", rows.limit(0))):
        at = str(tmp_path / name)
        d.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).select("doc_id", "piece", "length", "sequence_id", "offset").collect()
        if name == "empty":
            assert not got
            continue
        # Blank texts are one document; so are equal rows, with or without an id. 9000 words are more than one piece.
        ids = [r.doc_id for r in got if r.piece == 0]
        assert len(ids) == len(set(ids)) and {4, 5, 6, 10, 11, 12} <= set(ids) and len({1, 2, 3} & set(ids)) <= 1
        assert max(r.piece for r in got if r.doc_id == 6) > 0 and all(1 <= r.length <= 4096 for r in got)
        filled = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert filled.get(r.sequence_id, 0) == r.offset
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 4096

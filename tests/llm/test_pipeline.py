"""The pipeline's stages one by one, each against what it was given."""

import corpus_pipeline
from riskloom.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settle(stage(spark, docs, SF))
        if name != "bpe_encoding":
            assert docs.columns == columns
        if name in ("toxicity", "minhash_near_dedup"):
            assert all(given[r["doc_id"]] == r["text"] for r in docs.collect()) and docs.count() <= before.count()
        if name in ("secret_scan", "source_mixing", "bpe_encoding"):
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
        if name == "secret_scan":
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert docs.where("n_tokens != size(ids)").isEmpty()


def test_stages_on_edges(spark):
    rows = [(1, "some words are here for once", "en", "a", 5), (1, "some words are here for once", "en", "a", 5), (None, None, None, None, None), (2, "", None, "a", 0), (3, "word " * 20000, None, None, None), (None, "other words are there", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *[f"'clash' as {c}" for c in ("score", "key", "root", "u", "copies", "spans", "_n")])
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, given = given, settle(stage(spark, given, SF))
            if name != "bpe_encoding":
                assert given.columns == docs.columns
            if name == "minhash_near_dedup":
                assert given.count() == max(0, before.count() - 1)
            elif name in ("toxicity", "secret_scan", "bpe_encoding"):
                assert given.count() == before.count()
            else:
                assert given.count() >= before.count()

"""Each stage of the pipeline on its own input, against the operators' contracts."""
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components, brute_pii

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(P.STAGES)
    ruled = stage["quality_rules"](spark, docs, SF).cache()
    assert ruled.columns == columns and 0 < ruled.count() <= docs.count()
    single = stage["ngram_jaccard"](spark, ruled, SF).cache()
    want = brute_components([(r["doc_id"], r["text"]) for r in ruled.collect()])
    assert single.columns == columns and {r["doc_id"] for r in single.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}
    clean = stage["pii"](spark, single, SF).cache()
    assert clean.columns == columns and clean.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not brute_pii(r["text"])
        assert (r["text"] == before[r["doc_id"]]) or brute_pii(before[r["doc_id"]])
    mixed = stage["mix_sources"](spark, clean, SF).cache()
    assert mixed.columns == columns and mixed.join(clean, columns, "left_anti").count() == 0
    out = stage["bpe"](spark, mixed, SF)
    assert out.count() == mixed.count() and out.where(F.col("n_tokens") <= 0).count() == 0

"""Nulls, large and repeated ids, clashing columns and forced parts: the n-gram join, the mix, and every pipeline stage."""
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components

import corpus_pipeline as P
from lectern.llm import mixing, ngram_join, suffix_dedup


def family_docs(n=260):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    bases = [[word() for _ in range(rng.randint(40, 90))] for _ in range(8)]
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w + (passage if i % 3 == 0 else []))))
    return out


def test_join_in_small_parts_equals_brute_force(spark, monkeypatch):
    rows = family_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for part, group, queries in ((1 << 17, 1 << 18, 1 << 19), (400, 300, 500)):
        monkeypatch.setattr(ngram_join, "PART", part)
        monkeypatch.setattr(ngram_join, "GROUP", group)
        monkeypatch.setattr(ngram_join, "QUERIES", queries)
        assert {r[0]: (r[1], r[2]) for r in ngram_join.ngram_jaccard(df).collect()} == want
    assert len({c for _, c in want.values()}) < 150


def test_join_of_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " more"
    big = (1 << 63) - 1
    rows = [(big, text), (big - 1, near), (None, text + " x"), (None, None), (7, "alone here"), (7, "alone here"), (8, "other text with five words"), (8, text), (None, "lone row with no id at all"), (-(1 << 63), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join.ngram_jaccard(df).collect()), key=str)
    assert len(got) == len(rows)
    assert {(i, c) for i, n, c in got if n in (36, 37)} == {(big, 8), (big - 1, 8), (None, 8), (8, 8)}
    assert (None, 0, None) in got and (None, 3, None) in got and got.count((7, 1, 7)) == 2 and (-(1 << 63), 0, -(1 << 63)) in got


def test_mix_of_any_rate(spark):
    rows = [(1, "x", "tiny"), *[(10 + i, "y" * 2000, "big") for i in range(20)], (None, "z" * 500, None), (5, None, "none"), (10, "y" * 2000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("c"))
    out = mixing.mix_sources(df, seed=3, copy="n", shuffle_key="k")
    counts = {r["source"]: r["c"] for r in out.groupBy("source").agg(F.count("*").alias("c")).collect()}
    share = (1 + 21 * 2000 + 500) / 3
    assert abs(counts["tiny"] / share - 1) < 0.05 and "none" not in counts and set(out.columns) == {"doc_id", "text", "source", "copy", "n", "k"}
    assert out.where("source = 'tiny'").select("n").distinct().count() == counts["tiny"] and out.where("copy <> 'c'").count() == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_every_stage_on_odd_rows(spark):
    long = " ".join(f"{a}{b}ord" for a in "abcdefgh" for b in "stuvwxyz")
    rows = [(1, long, "en", "a", 5, "k"), (1, long, "en", "a", 5, "k"), (2, long, None, None, None, None), (None, long + " one", "en", "a", 1, "k"), (3, None, "en", "b", 0, "k"), (4, "", "en", "b", 0, "k"), (5, "mail a@b.co " + long, "en", "b", 9, "k"), (6, "big " * 200_000, "en", "b", 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for c, v in (("copy", 7), ("pii", "p"), ("_row", "r"), ("base_failed", "b"), ("component_id", 1)):
        docs = docs.withColumn(c, F.lit(v))
    stage = dict(P.STAGES)
    ruled = stage["quality_rules"](spark, docs, "")
    assert ruled.columns == docs.columns and sorted(str(r["doc_id"]) for r in ruled.collect()) == ["1", "1", "2", "5", "None"] and {r["kept"] for r in ruled.collect()} == {"k", None}
    single = stage["ngram_jaccard"](spark, docs, "")
    assert single.columns == docs.columns and sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "1", "3", "4", "6", "None"]
    clean = stage["pii"](spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == len(rows) and "mail <EMAIL> asord" in clean.where("doc_id = 5").first()["text"] and clean.where("pii <> 'p' or copy <> 7").count() == 0
    mixed = stage["mix_sources"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.where("text is not null and text <> ''").count() == mixed.where("copy = 7").count()
    assert stage["bpe"](spark, docs, "").count() == len(rows)
    for name, f in P.STAGES:
        out = f(spark, docs.limit(0), "")
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_texts_beyond_the_places_are_refused(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PLACE", np.uint64(255))
    assert len(suffix_dedup.segments(["x" * 256])[0]) and pytest.raises(ValueError, suffix_dedup.segments, ["x" * 257])

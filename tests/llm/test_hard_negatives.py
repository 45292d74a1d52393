"""Hard negatives against a comparison of all pairs; bounds hold; odd rows; small tiles, chunks and stripes."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives as H


def all_pairs(rows, every=5):
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, label, v in ok:
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in ok if i != a]
        for p, pid, _ in sorted([s for s in scored if s[2] == label], key=first)[:5]:
            fits = sorted([s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p], key=first)[:3]
            out += [(a, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def vectors(n=400, dims=6, labels=4):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [round(x + rng.gauss(0, 0.4), rng.choice([1, 3])) for x in c], 0 if rng.random() < 0.4 else rng.randrange(labels)))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def single(rows):
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


@pytest.mark.parametrize("tiles", [(4096, 256, 64, 8192), (7, 3, 1, 11)])
def test_all_pairs(spark, monkeypatch, tiles):
    for name, n in zip(("TILE_ROWS", "TILE_ANCHORS", "CHUNK", "STRIPE"), tiles):
        monkeypatch.setattr(H, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    rows = vectors(140 if tiles[0] == 7 else 400)
    got = H.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == all_pairs(single(rows))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60) + [(60, None, 1), (65, [1.0] * 6, None), (70, [nan] * 6, 1), (75, [inf] + [0.0] * 5, 1), (80, [None] + [0.0] * 5, 1), (85, [], 2), (90, [2.0, 1.0], 2), (None, [1.0] * 6, 2), (None, [1.0] * 6, 1), (None, [0.9] * 6, 3)]
    rows += [(i, [1.0] * 6, i % 3) for i in range(100, 130)] + [(131, [1.0] * 6, 1)] * 4 + [(135, [0.0] * 6, 0), (140, [-1.0] * 6, -7)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "'x' as a", "2 as v", "3 as q")
    got = sorted(map(tuple, H.mine(df, F.col("vec_id") % 5 == 0).collect()), key=str)
    padded = [(i, v and v + [0.0] * (6 - len(v)) if v != [] else [0.0] * 6, k) for i, v, k in single(rows)]
    assert got == all_pairs(padded) and any(r[3] is None for r in got)
    assert H.mine(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0 and H.mine(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        H.mine(spark.createDataFrame([(5, [1e30], 1)], SCHEMA), F.lit(True))


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(6)
    q = np.floor(256 * rng.normal(0, 0.125, (3000, 33))).astype(np.int64)
    coder = H.Coder(H.fit_books(q[:1500], 33))
    wide = coder.wide(q)
    codes, left = coder.encode(wide)
    low, high = coder.bounds(coder.tables(wide[:50]), H.norms(wide[:50], coder.m), codes, left, float(np.sqrt((q**2).sum(1).max())))
    exact = q @ q[:50].T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 2 * exact.std()


def test_query_on_its_table(spark):
    from lectern.llm.queries import op12_hard_negatives

    sf = "/root/testdata/sf0.01"
    rows = [(i, v, k if i % 7 else (k + 1) % 10) for i, v, k in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op12_hard_negatives(spark, sf).collect()), key=str) == all_pairs(rows, 50)

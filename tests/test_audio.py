"""Captured audio: one piece or many, table or stream, the same bytes; windows of media with a recogniser that is a stub."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import audio as A
from lectern.streaming import live


def whole(x, rate):
    """All input at once, by its definition."""
    n = len(x) if rate == A.RATE else -(-(len(x) - 1) * A.RATE // rate)
    out = [x[i] if rate == A.RATE else x[i * rate // A.RATE] * (1 - (i * rate % A.RATE) / A.RATE) + x[i * rate // A.RATE + 1] * ((i * rate % A.RATE) / A.RATE) for i in range(n)]
    return A.quantised(np.array(out)).tobytes()


def test_pieces_streams_and_tables(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 500)
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k, rate in enumerate((16_000, 44_100, 48_000, 8_000, 11_025)):
        x = np.concatenate([rng.normal(0, 0.6, 3000), [2.0, -2.0, 0.0]])
        want[k] = whole(x, rate)
        cut = sorted(rng.integers(0, len(x), 12).tolist())
        rows += [(k, i, rate, [float(v) for v in x[a:z]]) for i, (a, z) in enumerate(zip([0, *cut], [*cut, len(x)]))]
    df = spark.createDataFrame(rows, "session long, seq long, rate int, samples array<double>")
    for made in (A.audio_chunks(df), live.run_to_end(A.audio_chunks(live.in_parts(df, "session", F.floor(F.col("seq") / 5), 3)), "audio")):
        got = {}
        for r in made.orderBy("session", "chunk").collect():
            got[r["session"]] = got.get(r["session"], b"") + bytes(r["pcm"])
        assert got == want
    assert max(r["n"] for r in A.audio_chunks(df).select(F.length("pcm").alias("n")).collect()) == 1000
    assert A.audio_chunks(df.limit(0)).count() == 0
    assert A.quantised(np.array([1.0, -1.0, 0.5, float("nan"), 9.0])).tolist() == [32767, -32768, 16383, 0, 32767]


def test_media_windows(spark):
    media = spark.createDataFrame([(1, b"abc", 95.0), (2, b"", 30.0), (3, b"x", None), (4, b"y", 10.0)], "id long, content binary, seconds double")
    speech = lambda c, a, z: [(1.0, 2.0, f" {len(c)}@{a:.0f} "), (3.0, 99.0, "late"), (5.0, 4.0, "no")] if c else []
    heard = A.recognised(media, speech, cancelled=media.where("id = 4"))
    got = sorted((r["id"], r["window"], r["start"], r["finish"], r["text"]) for r in heard.collect() if r["text"])
    assert got == sorted([(1, w, 30.0 * w + 1, 30.0 * w + 2, f"3@{30 * w}") for w in range(4)] + [(1, w, 30.0 * w + 3, min(95.0, 30.0 * w + 30), "late") for w in range(4)])
    p = {r["id"]: (r["done"], r["windows"], r["progress"]) for r in A.progress(heard.where("not (id = 1 and window > 1)"), media).collect()}
    assert p == {1: (2, 4, 0.5), 2: (1, 1, 1.0), 4: (0, 1, 0.0)}
    assert [r["segment"] for r in A.numbered_segments(heard).orderBy("start").collect()] == list(range(8))


def test_samples_of_a_row_are_taken_as_they_come():
    assert A._numbers(None).tolist() == [] and A._numbers([None, 0.5]).tolist() == [0.0, 0.5] and A._numbers([]).dtype == np.float64
    x = np.array([0.25, 0.5])
    assert A._numbers(x) is x

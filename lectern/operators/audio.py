"""Captured audio to what a recogniser takes: 16,000 samples a second, 16 bits, in chunks of 48,000; and windows of media
that a recogniser reads one by one.

Resampling carries its place in the input across the pieces that a capture comes in, so however the input is cut, the same
bytes come out; a stream keeps that place, the last sample and what no chunk has yet as its state."""
from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.streaming.live import folded

#: Samples a second that come out, samples of a chunk, seconds of a media window (fixed values).
RATE, CHUNK, WINDOW = 16_000, 48_000, 30.0

#: (media bytes, begin, end of the window) to [(start, end, text)] in seconds from its begin.
Recogniser = Callable[[bytes, float, float], list[tuple[float, float, str]]]


def resampled(state: tuple[int, int, float], samples: np.ndarray, rate: int) -> tuple[tuple[int, int, float], np.ndarray]:
    """(state, samples at RATE) of a piece of input at `rate`: each output lies on the line between its two neighbours in the
    input. state: samples that came in and went out so far, and the last one that came in. Places are exact fractions."""
    came, went, last = state
    if rate == RATE or not len(samples):
        return (came + len(samples), went + (len(samples) if rate == RATE else 0), float(samples[-1]) if len(samples) else last), samples
    have = np.concatenate([[last], samples]) if came else samples
    first = came - 1 if came else 0  # index of have[0] in the whole input
    total = came + len(samples)
    # The next outputs whose right neighbour has come: floor(i * rate / RATE) + 1 <= total - 1.
    upto = max(went, (max(total - 1, 0) * RATE + rate - 1) // rate)
    i = np.arange(went, upto, dtype=np.int64)
    low = i * rate // RATE
    t = (i * rate % RATE) / RATE
    out = have[low - first] * (1 - t) + have[np.minimum(low + 1, total - 1) - first] * t if len(i) else np.zeros(0)
    return (total, int(upto), float(samples[-1])), out


def quantised(samples: np.ndarray) -> np.ndarray:
    """Samples as 16-bit numbers, clamped to [-1, 1]; what is not a number is silence."""
    s = np.clip(np.nan_to_num(samples, nan=0.0, posinf=1.0, neginf=-1.0), -1, 1)
    return np.trunc(np.where(s < 0, s * 32768, s * 32767)).astype("<i2")


def _numbers(samples) -> np.ndarray:
    """Samples as they come in a row; a null is silence."""
    x = np.zeros(0) if samples is None else np.asarray(samples)
    return np.array([0.0 if v is None else v for v in x], np.float64) if x.dtype == object else x.astype(np.float64, copy=False)


def audio_chunks(pieces: DataFrame, key: str = "session") -> DataFrame:
    """(key, chunk, pcm) of pieces (key, seq, rate, samples: array of float) of a capture, as a stream or a table: chunks of
    CHUNK samples as little-endian bytes, numbered from 0; the last one is shorter. A null sample is silence."""

    def step(state, row):
        came, went, last, number, left = state
        x = _numbers(row["samples"])
        (came, went, last), out = resampled((came, went, last), x, int(row["rate"]))
        have = base64.b64decode(left) + quantised(out).tobytes()
        whole = len(have) // (2 * CHUNK)
        made = [(number + i, have[2 * CHUNK * i : 2 * CHUNK * (i + 1)]) for i in range(whole)]
        return [came, went, last, number + whole, base64.b64encode(have[2 * CHUNK * whole :]).decode()], made

    def end(state):
        return [(state[3], base64.b64decode(state[4]))] if state[4] else []

    return folded(pieces, key, "chunk long, pcm binary", lambda: [0, 0, 0.0, 0, ""], step, end)


def media_windows(media: DataFrame, key: str = "id", seconds: str = "seconds", length: float = WINDOW) -> DataFrame:
    """(key, window, begin, end): the windows of each medium, the last one shorter; none where its length is not known."""
    n = F.ceil(F.col(seconds) / length).cast("long")
    w = media.where((F.col(seconds) > 0) & ~F.isnan(F.col(seconds).cast("double"))).select(key, F.col(seconds).cast("double").alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("window"))
    return w.select(key, "window", (F.col("window") * length).alias("begin"), F.least(F.col("_s"), (F.col("window") + 1) * length).alias("end"))


def recognised(media: DataFrame, recogniser: Recogniser, key: str = "id", content: str = "content", seconds: str = "seconds", cancelled: DataFrame | None = None) -> DataFrame:
    """(key, window, begin, end, start, finish, text) of the segments that a recogniser hears in each window, in seconds of
    the medium; a window without speech has one row without text, so progress can be told from the rows there are. Media in
    `cancelled` (key) are left out. Windows are dealt out one by one: a long medium is many tasks' work."""
    kinds = dict(media.dtypes)
    w = media_windows(media, key, seconds)
    if cancelled is not None:
        w = w.join(cancelled.select(key).distinct(), key, "left_anti")
    asked = w.repartition(key, "window").join(media.select(key, F.col(content).alias("_content")), key)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for k, n, a, z, c in zip(*[pdf[x] for x in (key, "window", "begin", "end", "_content")], strict=True):
                heard = [(a + s, min(z, a + e), t.strip()) for s, e, t in recogniser(bytes(c) if c is not None else b"", a, z) if t and t.strip() and math.isfinite(s) and e > s]
                rows += [(k, n, a, z, *h) for h in heard] or [(k, n, a, z, None, None, None)]
            yield pd.DataFrame(rows, columns=[key, "window", "begin", "end", "start", "finish", "text"])

    return asked.mapInPandas(run, f"`{key}` {kinds[key]}, window long, begin double, end double, start double, finish double, text string")


def progress(heard: DataFrame, media: DataFrame, key: str = "id", seconds: str = "seconds") -> DataFrame:
    """(key, done, windows, progress): how much of each medium is heard, from 0 to 1."""
    n = media_windows(media, key, seconds).groupBy(key).agg(F.count("*").alias("windows"))
    d = heard.groupBy(key).agg(F.countDistinct("window").alias("done"))
    return n.join(d, key, "left").select(key, F.coalesce("done", F.lit(0)).alias("done"), "windows", (F.coalesce("done", F.lit(0)) / F.col("windows")).alias("progress"))


def numbered_segments(heard: DataFrame, key: str = "id") -> DataFrame:
    """Segments with text, numbered from 0 in the order of their start."""
    w = Window.partitionBy(key).orderBy("start", "finish", "text")
    return heard.where("text is not null").withColumn("segment", (F.row_number().over(w) - 1).cast("long"))

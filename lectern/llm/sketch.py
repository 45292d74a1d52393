"""A frequency sketch of fixed size over all documents, and batches of texts for numpy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the frequency sketch: 4 MB, whatever the input.
SLOTS = 1 << 20
#: Characters per numpy batch.
BATCH = 1 << 19


def batches(pdfs: Iterator[pd.DataFrame], key: str, text: str) -> Iterator[tuple[np.ndarray, list]]:
    """(ids, texts) of about BATCH characters each."""
    ids, texts, held = [], [], 0
    for pdf in pdfs:
        for i, t in zip(pdf[key].tolist(), pdf[text].tolist(), strict=True):
            ids.append(i)
            texts.append(t if isinstance(t, str) else None)
            held += len(texts[-1] or "")
            if held > BATCH:
                yield np.array(ids, np.int64), texts
                ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def heavy_slots(measured: DataFrame, excess: float | None = None) -> np.ndarray:
    """Which slots of the sketch count over `excess` more than the mean (by default, more than chance would); the sums of
    the tasks' counts are 16 rows."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOTS // 16, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, "<i8" if len(c) == 8 * len(total) else "<i4")
        return pd.DataFrame({"part": [pdf["part"][0]], "salt": [0], "counts": [total.tobytes()]})

    schema = "part int, salt int, counts binary"
    sums = measured.where("part >= 0").select("part", F.pmod(F.xxhash64("counts"), F.lit(64)).cast("int").alias("salt"), "counts")
    sums = sums.groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema)
    counts = np.zeros((16, SLOTS // 16), np.int64)
    for r in sums.collect():
        counts[r["part"]] = np.frombuffer(r["counts"], "<i8")
    counts = counts.ravel()
    return counts > counts.mean() + (8 + 4 * counts.mean() ** 0.5 if excess is None else excess)

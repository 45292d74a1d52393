"""Checks of requests, archives and reviews: each group of rows is accepted or rejected as a whole, with the first reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a service that a later try may mend, and the longest wait it may ask for (fixed values).
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
LONGEST_WAIT = 15_000


def _first(*reasons: tuple[Column, str]) -> Column:
    out = F.when(F.lit(False), "")
    for test, why in reasons:
        out = out.when(F.coalesce(test, F.lit(False)), why)
    return out.otherwise("ok").alias("verdict")


def _repeated(key: str) -> Column:
    return F.count("*") != F.countDistinct(key)


def batch_verdict(rows: DataFrame, group: str, key: str, text: str, most: int, chars: int) -> DataFrame:
    """(group, verdict) of batches: at most `most` rows and `chars` characters, distinct keys, no blank text."""
    blank = F.max(F.trim(F.coalesce(F.col(text), F.lit(""))) == "")
    return rows.groupBy(group).agg(_first((F.count("*") > most, "too many"), (_repeated(key), "repeated id"), (blank, "blank"), (F.sum(F.length(text)) > chars, "too long")))


def record_verdict(rows: DataFrame, group: str, key: str, start: str, end: str, text: str, most: int, chars: int) -> DataFrame:
    """(group, verdict) of archives: distinct keys, finite times with end after start, starts that never go back in the order
    of keys, at most `most` rows and `chars` characters."""
    r = rows.withColumn("_before", F.lag(start).over(Window.partitionBy(group).orderBy(key)))
    times = F.max((F.col(start) < 0) | (F.col(end) <= F.col(start)) | F.isnan(start) | F.isnan(end) | F.col(start).isNull() | F.col(end).isNull())
    order = F.max(F.col(start) < F.col("_before"))
    return r.groupBy(group).agg(_first((F.count("*") > most, "too many"), (_repeated(key), "repeated id"), (times, "times"), (order, "order"), (F.sum(F.length(text)) > chars, "too long")))


def review_verdict(flags: DataFrame, known: DataFrame, group: str, key: str, reason: str, reasons: tuple[str, ...]) -> DataFrame:
    """(group, accepted, n): whether all flags of a group name a known row, each once, with a known reason."""
    k = known.select(group, key).distinct().withColumn("_known", F.lit(True))
    g = flags.join(k, [group, key], "left")
    good = F.min(F.coalesce("_known", F.lit(False)) & F.col(reason).isin(*reasons))
    return g.groupBy(group).agg((good & ~_repeated(key)).alias("accepted"), F.count("*").alias("n"))


def unknown_marker(text: Column, values: Column) -> Column:
    """True if a text has a marker of a literal that does not exist (values is their number)."""
    marks = F.regexp_extract_all(text, F.lit("QS_PROTECTED_([0-9]+)"), F.lit(1))
    return F.exists(marks, lambda m: F.coalesce(m.try_cast("long") >= values, F.lit(True)))


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def retry_after(attempt: Column, jitter: Column, asked: Column) -> Column:
    """Milliseconds before the next try: the seconds that the service asked for, within bounds, or the growing delay."""
    from lectern.functions.text import retry_delay

    return F.when(asked.isNotNull(), F.least(F.lit(LONGEST_WAIT), F.greatest(F.lit(0), asked * 1000)).cast("long")).otherwise(retry_delay(attempt, jitter))

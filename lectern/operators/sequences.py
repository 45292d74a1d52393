"""Order-sensitive operators on keyed sequences: windows, ordered folds, as-of and interval lookups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.runs import greedy_batches  # noqa: F401


def context_before(rows: DataFrame, key: str, order: str, text: str, n: int = 4, chars: int = 1600) -> DataFrame:
    """rows with `context`: the n texts before, joined by spaces, of which the last `chars` characters count."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return rows.withColumn("context", F.right(F.array_join(F.collect_list(text).over(w), " "), F.lit(chars)))


def gap_sessions(rows: DataFrame, key: str, time: str, tie: str, gap_seconds: float) -> DataFrame:
    """rows with `session` (from 0): a new one where the gap to the row before reaches the limit."""
    w = Window.partitionBy(key).orderBy(time, tie)
    new = F.coalesce((F.col(time).cast("timestamp").cast("double") - F.lag(time).over(w).cast("timestamp").cast("double") >= gap_seconds).cast("long"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def adjacent_distinct(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """rows whose value differs from that of the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_v", value).withColumn("_before", F.lag("_v").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("_v"))).drop("_v", "_before")


def ready_prefix(rows: DataFrame, key: str, order: str, done: Column, end: str) -> DataFrame:
    """(key, ready): the largest end within the unbroken run of done rows from the start; 0 if the first isn't done."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ok = rows.withColumn("_ok", F.min(done.cast("int")).over(w))
    return ok.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_ok") == 1, F.col(end))), F.lit(0)).alias("ready"))


def asof_backward(probes: DataFrame, lines: DataFrame, key: str, time: str, value: str, probe_id: str) -> DataFrame:
    """probes with the value of the last line at or before their time, by one sort per key over the union of both."""
    tie = F.lit(0)
    u = lines.select(key, time, tie.alias("_k"), F.col(value).alias("_v"), F.lit(None).cast("long").alias(probe_id)).unionByName(probes.select(key, time, F.lit(1).alias("_k"), F.lit(None).cast(lines.schema[value].dataType).alias("_v"), F.col(probe_id).cast("long")))
    w = Window.partitionBy(key).orderBy(time, "_k", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("found", F.last("_v", ignorenulls=True).over(w)).where("_k = 1").select(key, probe_id, time, "found")


def in_interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= at < end: spans are dealt to the buckets of `width` they touch, points to theirs, so the range
    join is an equi-join with a filter. width should be near the usual length of a span."""
    buckets = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(buckets))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(s, "_b").where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_b")


def latest(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row per key: the first by the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def merge_snapshots(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upsert: new rows win, but a blank new value keeps the old one; rows of either side only stay."""
    o, n = old.select(*keys, F.col(value).alias("_o")), new.select(*keys, F.col(value).alias("_n"))
    return o.join(n, keys, "full").select(*keys, F.coalesce(F.nullif(F.col("_n"), F.lit("")), F.col("_o"), F.lit("")).alias(value))

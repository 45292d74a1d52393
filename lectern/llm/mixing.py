"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate so that the expected characters of sources stand in the target proportions.
A document's count is the inverse of the Poisson distribution with that mean at a uniform number hashed from its id and
the seed; the document is exploded by its count, and the copies are dealt out and sorted by another hash, which shuffles
them globally. Counts depend on nothing but id, source statistics and seed, so lost executors and other partitionings
give the same result.

A hot source costs nothing extra: statistics are pre-aggregated and written as a table; its rows are counted, and rates
reach documents by a broadcast up to SMALL_ROWS sources, by a plain join beyond. Copies are dealt out by their own hash, in
the only shuffle of texts. A count of any size is exploded in steps of CHUNK, so no array grows with a rate.

Defined results: a null source is a source of its own; sources without characters, or with weight 0, get no copies; a
null id is hashed as a fixed value; equal rows get equal counts; other columns stay; an empty table gives an empty table.
"""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SMALL_ROWS, written

#: Bits of a hashed uniform number, exact in a double.
BITS = 48
#: Standard deviations above the mean up to which the distribution is tabulated; the rest has a mass under 1e-15.
TAIL = 12
#: Largest mean whose exp(-mean) is far enough from a double's zero for sums to begin at 0.
SMALL = 600.0
#: Copies of a document that one array numbers.
CHUNK = 1000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts; the same in any engine that has MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose Poisson distribution function exceeds u. The terms are summed in k's order; means above SMALL
    begin TAIL standard deviations below the mean, with that term by Stirling's series."""
    large = mean > SMALL
    low = F.when(large, F.floor(mean - TAIL * F.sqrt(mean))).otherwise(0).cast("long")
    most = F.ceil(mean + TAIL * F.sqrt(mean) + 12).cast("long")
    k = F.greatest(low, F.lit(1)).cast("double")
    stirling = F.exp(k * F.log(mean / k) + (k - mean) - 1 / (12 * k) + 1 / (360 * k * k * k)) / F.sqrt(2 * math.pi * k)
    term = F.when(large, stirling).otherwise(F.exp(-mean))
    begin = F.struct(term.alias("term"), term.alias("sum"), low.alias("k"))
    step = lambda s, i: F.struct((s["term"] * mean / i).alias("term"), (s["sum"] + s["term"] * mean / i).alias("sum"), (s["k"] + F.when(u >= s["sum"], 1).otherwise(0)).alias("k"))
    return F.aggregate(F.sequence(low + 1, most), begin, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, text: str = "text", source: str = "source", epochs: float = 1.0) -> DataFrame:
    """(source, chars, rate): rate is the mean number of copies of a document of the source.

    `weights` are target shares of characters by source (sources not named get none); without it all sources get the
    same share. The mix has `epochs` times the characters of the input in expectation."""
    stats = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.length(F.coalesce(F.col(f"`{text}`"), F.lit("")))).cast("long").alias("chars")).where("chars > 0")
    if weights is None:
        stats = stats.withColumn("weight", F.lit(1.0))
    else:
        case = F.lit(0.0)
        for k, w in weights.items():
            if w < 0 or not math.isfinite(w):
                raise ValueError(f"weight of {k!r}: {w}")
            case = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(case)
        stats = stats.withColumn("weight", case)
    total = stats.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all_chars"))
    return stats.crossJoin(F.broadcast(total)).select("source", "chars", (F.col("weight") / F.col("weights") * F.col("all_chars") * F.lit(float(epochs)) / F.col("chars")).alias("rate")).where("rate > 0")


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", epochs: float = 1.0, seed: int = 0, copy: str = "copy", shuffle_key: str = "shuffle_key") -> DataFrame:
    """docs replicated to the target weights and shuffled, with the columns `copy` (from 0) and `shuffle_key`; columns of
    docs that have these names are replaced, so name others to keep them."""
    r = written(rates(docs, weights, text, source, epochs).select(F.col("source").alias("_m_source"), F.col("rate").alias("_m_rate")), "rates")
    r = F.broadcast(r) if r.count() <= SMALL_ROWS else r
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (copy, shuffle_key)]
    a = docs.select(*own).join(r, F.col(f"`{source}`").eqNullSafe(F.col("_m_source")))
    a = a.withColumn("_m_u", uniform(F.lit(seed), F.lit("count"), F.col(f"`{key}`")))
    a = a.withColumn("_m_n", poisson_inverse(F.col("_m_u"), F.col("_m_rate"))).where("_m_n > 0")
    a = a.withColumn("_m_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m_n") - 1) / CHUNK))))
    first = F.col("_m_chunk") * CHUNK
    a = a.select(*own, F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_m_n")) - 1)).alias(copy))
    a = a.withColumn(shuffle_key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{copy}`"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Hash partitions of a random key, sorted inside: a global shuffle without the extra pass of a range partitioning.
    return a.repartition(n, shuffle_key).sortWithinPartitions(shuffle_key)

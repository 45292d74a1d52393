"""What the corpus operators share: tables in the shared folder, partition counts, null-safe inputs."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import discard, shared_dir, written  # noqa: F401

#: ASCII white space: the separators of words.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression class for Java and RE2.
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Rows that Arrow hands to Python at once: texts can be long, and Spark's default of 10,000 rows has no bound in bytes.
ARROW_ROWS = "1000"


#: Rows of two numbers that are broadcast, counted first: 2 MB.
SMALL_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replayable(df: DataFrame) -> DataFrame:
    """df if it only reads, filters and projects files, so that each attempt of a task sees the same rows in the same
    order; otherwise written as a table first."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return df if plan.nodeName().startswith("Relation") or "LogicalRelation" in plan.getClass().getName() else written(df, "input")


def dealt(df: DataFrame, key: str, size: str, most: int, name: str) -> DataFrame:
    """df with `part`: groups of `key` whose `size` sums to over `most` are cut into parts by the hash of `name`. Only these
    groups are joined, from a written table, which is broadcast while it is small."""
    large = df.groupBy(key).agg(F.ceil(F.sum(size) / most).cast("int").alias("_parts")).where("_parts > 1")
    large = written(large, "large")
    large = F.broadcast(large) if large.count() <= SMALL_ROWS else large
    return df.join(large, key, "left").withColumn("part", F.pmod(F.xxhash64(name), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files behind df, from the file listing; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, mb: int = 16) -> int:
    """How many buckets keep each one's share of the input near `mb` MB of (compressed) files; where no file stands behind
    df (Spark then reports a size of many petabytes), the number of shuffle partitions."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return least if size >= 1 << 52 else max(least, math.ceil(size / (mb << 20)))


def smallest_by_hash(df: DataFrame, key: str, rows: int, text: str = "text") -> DataFrame:
    """The rows whose keys have the `rows` smallest hashes: the same sample whatever the partitioning. Only hashes are
    sorted; the rows themselves are filtered where they stand. Where many rows have one key (or none), so that more than
    twice as many would come, they count once for each text and are thinned to about `rows` by the hash of key and text."""
    h = F.xxhash64(key)
    cut = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if cut is None:
        return df.where(F.lit(False))
    some, content = df.where(h <= cut), F.xxhash64(key, text)
    if some.select(F.lit(1)).count() <= 2 * rows:
        return some
    found = some.select(content.alias("h")).distinct().count()
    thin = some.where(F.pmod(F.xxhash64(F.lit("thin"), content), F.lit(1 << 20)) < F.lit(min(1.0, rows / found)) * (1 << 20))
    return thin.withColumn("_content", content).dropDuplicates(["_content"]).drop("_content")

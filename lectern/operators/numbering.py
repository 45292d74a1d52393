"""Dense numbers over a whole table without a single-partition window."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import written


def number_rows(rows: DataFrame, by: list[str], name: str = "number", first: int = 1) -> DataFrame:
    """rows with dense numbers in the order of `by`: ranges are numbered apart, then shifted by the counts before them.

    The counts are one row per range, so only they pass a global window. Ranges and their local numbers are a written table,
    so a lost executor does not deal them anew; `by` should be unique, as ties could be numbered either way."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*by)
    local = written(dealt.withColumn("_rank", F.row_number().over(w)), "ranges")
    counts = local.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return local.join(counts.select("_part", "_before"), "_part").withColumn(name, (F.col("_before") + F.col("_rank") + first - 1).cast("long")).drop("_part", "_rank", "_before")

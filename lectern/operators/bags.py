"""Similar bags of texts (sessions, documents as bags of lines): an exact join by weighted Dice similarity."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Similarity, in hundredths, from which two bags are compatible (fixed value).
COMPATIBLE = 72


def similar_bags(items: DataFrame, key: str, text: str, threshold: int = COMPATIBLE) -> DataFrame:
    """(a, b, dice): pairs of keys with 200 * common >= threshold * (chars of a + chars of b), where common adds up the
    lengths of the texts that both hold, as often as both do.

    Equal bags are one class: pairs stand between the smallest keys of classes, and each other key of a class is paired with
    that one (dice 1). Two bags that link share at least threshold / (200 - threshold) of either's characters, so of the
    texts in any one order they share one among the first that make up the rest of the characters, plus one. The order puts
    texts of many bags last; only these prefixes meet, and the pairs that do are compared whole. Null texts are left out."""
    share = threshold / (200 - threshold)
    c = items.where(F.col(text).isNotNull()).groupBy(key, text).agg(F.count("*").alias("n"))
    c = c.select(key, F.xxhash64(text).alias("h"), F.md5(text).alias("m"), "n", (F.col("n") * F.length(text)).alias("w"))
    bag = c.groupBy(key).agg(F.sum("w").alias("chars"), F.sum(F.xxhash64("h", "n").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("m", "n").cast("decimal(38,0)")).alias("s2"), F.count("*").alias("texts"))
    named = bag.withColumn("rep", F.min(key).over(Window.partitionBy("s1", "s2", "chars", "texts")))
    copies = named.where(F.col("rep") != F.col(key)).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("dice"))
    one = named.where(F.col("rep") == F.col(key)).select(key, "chars")
    c = c.join(one, key)
    often = c.groupBy("h", "m").agg(F.count("*").alias("often")).where("often > 1")  # a text of one bag is in no pair
    shared = c.join(often, ["h", "m"])
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("w").over(w.orderBy("often", "h", "m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Texts that no other bag has stand before all others and count as read already.
    lone = F.col("chars") - F.sum("w").over(w)
    prefix = shared.withColumn("_p", lone + before).where(F.col("_p") <= F.col("chars") * (1 - share) + 1e-9).select(key, "chars", "h", "m")
    a, b = [prefix.select(F.col(key).alias(k), F.col("chars").alias("c" + k), "h", "m") for k in ("a", "b")]
    fit = (F.col("a") < F.col("b")) & (F.least("ca", "cb") >= share * F.greatest("ca", "cb") - 1e-9)
    pairs = a.join(b, ["h", "m"]).where(fit).select("a", "b", "ca", "cb").distinct()
    x = shared.select(F.col(key).alias("a"), "h", "m", F.col("n").alias("na"), F.col("w").alias("wa"))
    y = shared.select(F.col(key).alias("b"), "h", "m", F.col("n").alias("nb"))
    common = pairs.join(x, "a").join(y, ["b", "h", "m"]).groupBy("a", "b", "ca", "cb").agg(F.sum(F.least("na", "nb") * (F.col("wa") / F.col("na"))).cast("long").alias("common"))
    met = common.where(200 * F.col("common") >= threshold * (F.col("ca") + F.col("cb")))
    return met.select("a", "b", F.round(2.0 * F.col("common") / (F.col("ca") + F.col("cb")), 6).alias("dice")).union(copies)

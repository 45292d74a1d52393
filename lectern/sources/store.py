"""Records by key in a folder: folders of JSON files as they are, and a store of numbered tables with deletes and compaction.

The store is a log. Each change is a table of its own number, which counts once Spark has marked it complete, so a change is
there as a whole or not at all; a delete is a tombstone. The view of the store takes the last change of each key. Compaction
writes the view as one table and then drops what it replaces; readers of the older number are not disturbed by the new one.

Defined results: of several records of one key in one change the latest by time counts, then the greatest text; a record
without a key is refused by `read_folder` and left out by `put`; an empty store has an empty view."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import hadoop

CHANGE = "key string, document string, updated long, record string, gone boolean"


def read_folder(spark: SparkSession, where: str, prefix: str = "", fields: str = "key string, documentKey string, updatedAt long, pages array<string>") -> tuple[DataFrame, DataFrame]:
    """(records, set aside) of a folder of JSON files, one record each: (file, key, document, updated, record). Files whose
    name begins otherwise, or that are no object with a key and an array of pages, are set aside with their text."""
    files = spark.read.text(where, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))
    parsed = files.withColumn("r", F.from_json("record", fields))
    fine = F.coalesce(F.col("file").startswith(prefix) & (F.col("r.key") != "") & F.col("r.pages").isNotNull(), F.lit(False))
    good = parsed.where(fine).select("file", F.col("r.key").alias("key"), F.col("r.documentKey").alias("document"), F.coalesce("r.updatedAt", F.lit(0).cast("long")).alias("updated"), "record")
    return good, parsed.where(~fine).select("file", "record")


class Store:
    """Records (key, document, updated, record) in a folder."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def versions(self) -> list[int]:
        path, fs = hadoop(self.spark, self.where)
        if not fs.exists(path):
            return []
        whole = lambda n: fs.exists(hadoop(self.spark, f"{self.where}/{n}/_SUCCESS")[0])
        return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.isdigit() and whole(n))

    def _change(self, rows: DataFrame) -> int:
        n = max(self.versions(), default=-1) + 1
        rows.select(*[c.split()[0] for c in CHANGE.split(", ")]).write.mode("overwrite").parquet(f"{self.where}/{n}")
        return n

    def put(self, records: DataFrame) -> int:
        """Adds records, or replaces those of equal keys, as one change; its number."""
        last = records.where("key is not null").groupBy("key").agg(F.max(F.struct("updated", "record", "document")).alias("r"))
        return self._change(last.select("key", "r.document", F.col("r.updated").cast("long").alias("updated"), "r.record", F.lit(False).alias("gone")))

    def view(self) -> DataFrame:
        """(key, document, updated, record): what each key has after all changes."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], CHANGE).drop("gone")
        rows = None
        for n in found[max((i for i, n in enumerate(found) if self._compacted(n)), default=0) :]:
            change = self.spark.read.schema(CHANGE).parquet(f"{self.where}/{n}").withColumn("_n", F.lit(n))
            rows = change if rows is None else rows.unionByName(change)
        last = rows.groupBy("key").agg(F.max_by(F.struct("document", "updated", "record", "gone"), "_n").alias("r"))
        return last.where("not r.gone").select("key", "r.document", "r.updated", "r.record")

    def _compacted(self, n: int) -> bool:
        path, fs = hadoop(self.spark, f"{self.where}/{n}/_COMPACT")
        return fs.exists(path)

    def get(self, keys: DataFrame) -> DataFrame:
        return self.view().join(keys.select("key").distinct(), "key", "left_semi")

    def listed(self, prefix: str) -> DataFrame:
        """Records whose keys begin so."""
        return self.view().where(F.col("key").startswith(prefix))

    def _bury(self, rows: DataFrame) -> int:
        """Tombstones of rows; how many."""
        n = self._change(rows.withColumn("gone", F.lit(True)).withColumn("record", F.lit(None).cast("string")))
        return self.spark.read.schema(CHANGE).parquet(f"{self.where}/{n}").count()

    def delete_documents(self, documents: DataFrame) -> int:
        """Deletes the records of documents (document), and those whose key is a document's with a colon and more behind it;
        how many. A key meets documents by its beginnings up to each colon, in an equi-join."""
        parts = F.split("key", ":")
        begins = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), i), ":")))
        v = self.view().withColumn("_d", F.explode(F.array_distinct(F.filter(F.concat(F.array("document"), begins), lambda x: x.isNotNull()))))
        hit = v.join(documents.select(F.col("document").alias("_d")).distinct(), "_d", "left_semi").drop("_d").dropDuplicates(["key"])
        return self._bury(hit)

    def cleanup(self, cutoff: Column | int) -> int:
        """Deletes records older than a time; how many."""
        return self._bury(self.view().where(F.coalesce("updated", F.lit(0)) < cutoff))

    def copy_from(self, other: Store) -> int:
        """Takes all records of another store; how many."""
        n = self.put(other.view())
        return self.spark.read.schema(CHANGE).parquet(f"{self.where}/{n}").count()

    def compact(self) -> None:
        """Makes the view one table, marks it, and drops the changes before it."""
        n = self._change(self.view().withColumn("gone", F.lit(False)))
        path, fs = hadoop(self.spark, f"{self.where}/{n}/_COMPACT")
        fs.create(path).close()
        for old in self.versions():
            if old < n:
                fs.delete(hadoop(self.spark, f"{self.where}/{old}")[0], True)

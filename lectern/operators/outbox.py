"""Work that survives restarts: a table of segments, batches whose key is written before they are sent, answers joined back.

State is a folder of numbered tables. A step first claims: each session without a batch in flight gets its next one, with an
id that only depends on the session, the first segment and the attempt. That is written before anything is sent. Then it
asks: each claimed batch goes to the service, which knows its id (`streaming.live.submitted_jobs` tells such ids
apart), so asking again is a question and no second order. Whatever is interrupted, the last complete table is where to go
on: what was claimed is asked for again under the same id, what was answered is not asked for at all.

Sessions that are over leave the state for a table of results, so a step costs what is still open. One batch per session is
in flight; all sessions move together in one job.

Defined results: a blank source is translated as it is; answers that do not match their batch one to one are a failed
attempt; a segment that failed MOST_TRIES times makes its session failed, and what is translated stays."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.runs import cue_batches
from lectern.shared import hadoop

#: Attempts of a segment (a fixed value).
MOST_TRIES = 3
STATE = "session long, seq long, source string, start double, end double, translation string, tries int, request string, error string"

#: (request id, (segment id, text) pairs) to (status, answers): running, complete with (segment id, text) pairs, or failed.
Service = Callable[[str, list[tuple[str, str]]], tuple[str, list[tuple[str, str]]]]


class Outbox:
    """Segments (session, seq, source, start, end) of sessions on their way through a service, kept in a folder."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def _versions(self) -> list[int]:
        path, fs = hadoop(self.spark, f"{self.where}/state")
        if not fs.exists(path):
            return []
        whole = lambda s: fs.exists(hadoop(self.spark, f"{self.where}/state/{s}/_SUCCESS")[0])
        return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.isdigit() and whole(n))

    def _write(self, rows: DataFrame, version: int) -> None:
        # A table counts once Spark has marked it as complete; half a table of a lost driver is written over.
        rows.select(*[f"`{c.split()[0]}`" for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.where}/state/{version}")
        for old in self._versions()[:-2]:
            path, fs = hadoop(self.spark, f"{self.where}/state/{old}")
            fs.delete(path, True)

    def state(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.where}/state/{self._versions()[-1]}")

    def begin(self, segments: DataFrame) -> None:
        """Puts segments into an empty outbox; one that has a state is left as it is, so a restart may call this again."""
        if not self._versions():
            blank = F.trim(F.coalesce("source", F.lit(""))) == ""
            none = F.lit(None).cast("string")
            rows = segments.select("session", "seq", F.coalesce("source", F.lit("")).alias("source"), F.col("start").cast("double"), F.col("end").cast("double"))
            self._write(rows.withColumns({"translation": F.when(blank, F.col("source")), "tries": F.lit(0), "request": none, "error": none}), 0)

    def claim(self) -> None:
        """Writes a request id to the next batch of each session that has none in flight."""
        s, version = self.state(), self._versions()[-1]
        w = Window.partitionBy("session")
        open_ = F.col("translation").isNull() & (F.col("tries") < MOST_TRIES)
        s = s.withColumns({"_open": open_, "_busy": F.max(F.col("request").isNotNull()).over(w)})
        # A batch is a run of open segments: what is translated between two parts them.
        gap = F.sum(F.when(F.col("_open"), 0).otherwise(1)).over(w.orderBy("seq"))
        free = s.withColumn("_gap", gap).where("_open and not _busy")
        first = free.groupBy("session").agg(F.min("_gap").alias("_gap"))
        run = free.join(first, ["session", "_gap"])
        mine = cue_batches(run, "session", "seq").where("batch = 0").select("session", "seq", F.lit(True).alias("_mine"))
        s = s.join(mine, ["session", "seq"], "left")
        lead = F.min(F.when(F.col("_mine"), F.struct("seq", "tries"))).over(w)
        name = F.sha2(F.concat_ws(":", "session", F.col("_lead.seq"), F.col("_lead.tries")), 256)
        s = s.withColumn("_lead", lead).withColumn("request", F.when(F.col("_mine"), name).otherwise(F.col("request")))
        self._write(s.withColumn("tries", F.when(F.col("_mine"), F.col("tries") + 1).otherwise(F.col("tries"))), version + 1)

    def ask(self, service: Service) -> None:
        """Asks the service for every batch in flight and writes what has come."""
        s, version = self.state(), self._versions()[-1]
        each = F.array_sort(F.collect_list(F.struct("seq", "source")))
        asked = s.where("request is not null").groupBy("session", "request").agg(each.alias("items"))

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                rows = []
                for session, request, items in zip(pdf["session"], pdf["request"], pdf["items"], strict=True):
                    cues = [(str(x["seq"]), x["source"]) for x in items]
                    status, answers = service(request, cues)
                    said = {i: t.strip() for i, t in answers if isinstance(t, str) and t.strip()} if status == "complete" else {}
                    fits = status == "complete" and len(answers) == len(cues) == len(said) and all(i in said for i, _ in cues)
                    over = status in ("complete", "failed")
                    error = None if fits or not over else "failed" if status == "failed" else "misaligned"
                    rows += [(session, int(i), said[i] if fits else None, over, error) for i, _ in cues]
                yield pd.DataFrame(rows, columns=["session", "seq", "_said", "_over", "_error"])

        came = asked.mapInPandas(run, "session long, seq long, _said string, _over boolean, _error string")
        s = s.join(came, ["session", "seq"], "left")
        over = F.coalesce("_over", F.lit(False))
        new = {"translation": F.coalesce("translation", "_said"), "request": F.when(~over, F.col("request")), "error": F.when(over, F.col("_error")).otherwise(F.col("error"))}
        self._write(s.withColumns(new), version + 1)

    def settle(self) -> None:
        """Moves sessions that are over to the results."""
        s, version = self.state(), self._versions()[-1]
        w = Window.partitionBy("session")
        more = F.col("request").isNotNull() | (F.col("translation").isNull() & (F.col("tries") < MOST_TRIES))
        s = s.withColumn("_more", F.max(more).over(w))
        # Results of a version are written over if it is settled again.
        s.where("not _more").drop("_more").write.mode("overwrite").parquet(f"{self.where}/results/version={version}")
        self._write(s.where("_more"), version + 1)

    def step(self, service: Service) -> bool:
        """One round for all sessions; whether any is left."""
        self.claim()
        self.ask(service)
        self.settle()
        return not self.state().isEmpty()

    def run(self, segments: DataFrame, service: Service, most: int = 10_000) -> DataFrame:
        """All rounds from wherever the outbox is; (session, seq, translation, error, status) of all segments."""
        self.begin(segments)
        for _ in range(most):
            if not self.step(service):
                break
        return self.results()

    def results(self) -> DataFrame:
        """Segments of sessions that are over: status is complete where all of a session is translated, else failed."""
        # A session that was settled twice, around a restart, has the same rows twice.
        rows = self.spark.read.schema(STATE + ", version int").parquet(f"{self.where}/results").drop("version").dropDuplicates(["session", "seq"])
        whole = F.min(F.col("translation").isNotNull()).over(Window.partitionBy("session"))
        return rows.select("session", "seq", "translation", "error", F.when(whole, "complete").otherwise("failed").alias("status"))

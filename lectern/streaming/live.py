"""Structured Streaming operators of live captions and events, and a way to run them to the end of their input.

Folds over a key keep their state with a timeout, so that sessions which end without a flush do not stay for ever; what is
pending then is emitted. Rows of a key are folded in the order of `seq` within a micro-batch."""
from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.text import credit_line
from lectern.shared import fresh, written
from lectern.streaming import folds

#: How long a key's state stays without new rows (ms).
KEEP_MS = 3_600_000


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the rows of a table (a folder, or one file), with the table's schema."""
    # As a pattern, since a stream takes one file for a folder otherwise.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


#: Bytes of input for one file of a step.
STEP_BYTES = 4 << 20


def in_parts(rows: DataFrame, key: str, part: Column, parts: int, name: str = "parts") -> DataFrame:
    """A stream over rows in `parts` micro-batches (part counts from 0). Each is written as files, one after the other, so
    that a step's rows come before the next one's; the rows of a key are in one file of a step. All steps have the same
    number of files (a filler row keeps an empty one there), so that a micro-batch is one step and never parts of two."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, math.ceil(size / STEP_BYTES)))
    where = fresh(spark, name)
    own = rows.withColumn("_file", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("_filler", F.lit(False))
    fillers = spark.range(n).select(F.col("id").cast("int").alias("_file"), F.lit(True).alias("_filler"))
    for i in range(parts):
        own.where(part == i).unionByName(fillers, allowMissingColumns=True).repartitionById(n, "_file").write.parquet(f"{where}/{i}")
    read = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", n).parquet(f"{where}/*")
    return read.where("not _filler").drop("_file", "_filler")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """The rows of a stream over all input there is, as a table in the shared folder.

    A micro-batch writes its own folder, named by its number and written over when it is repeated, so a restart makes no
    duplicates. In update mode the last batch's row of each key counts; in complete mode the last batch's rows. What a
    fold (`folded`) still holds at the end of the input is read from its state and emitted, as its time-out would."""
    spark = stream.sparkSession
    root, state = fresh(spark, name), fresh(spark, name + "-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    # State with a time-out in processing time would ask for empty batches for ever. The query has its own copy of the
    # session once it has started, so the caller's setting is put back then.
    fold = getattr(stream, "_fold", None)
    options = getattr(stream, "_options", {}) | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if fold else {})
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").option("recursiveFileLookup", "false").parquet(root)
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    if mode == "update" and keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
    rows = rows.drop("batch")
    return rows.unionByName(written(fold.rest(spark, state), name + "-rest")) if fold and fold.end else rows


def windowed(events: DataFrame, time: str, size: str, by: list[str], aggs: list, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates per event-time window and key; state goes once the watermark has passed a window's end."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("start"), *by, *[a._jc.toString().split(" AS ")[-1].strip("`") for a in aggs])


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    """Aggregates per session: a key's events without a pause of `gap`."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)


class Fold(NamedTuple):
    """How a stream was folded, for what its state holds when the input has ended."""

    keys: list[str]
    names: list[str]
    schema: str
    end: Callable[[object], list[tuple]] | None

    def rest(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """What end() makes of each key's state, read from the state store behind the last micro-batch."""
        held = spark.read.format("statestore").load(checkpoint)
        state = held.select(*[F.col(f"key.`{k}`").alias(k) for k in self.keys], F.col("value.groupState.state").alias("_state"))

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                made = [(*r[:-1], *x) for r in pdf.itertuples(index=False, name=None) for x in self.end(json.loads(r[-1]))]
                yield pd.DataFrame(made, columns=[*self.keys, *self.names])

        return state.mapInPandas(run, self.schema)


def in_order(pdfs: list[pd.DataFrame], by: list[str]) -> list[dict]:
    """Rows of a key in order. Most keys have a few rows, for which the ways of pandas cost more than the fold itself."""
    names = list(pdfs[0].columns)
    rows = [dict(zip(names, r, strict=True)) for pdf in pdfs for r in zip(*[pdf[c].tolist() for c in names], strict=True)]
    return sorted(rows, key=lambda r: [(pd.isna(r[c]), 0 if pd.isna(r[c]) else r[c]) for c in by]) if len(rows) > 1 else rows


def folded(stream: DataFrame, key: str | list[str], out: str, begin: Callable[[], object], step: Callable[[object, dict], tuple[object, list[tuple]]], end: Callable[[object], list[tuple]] | None = None, keep_ms: int = KEEP_MS) -> DataFrame:
    """A fold per key over the rows of a stream (which have `seq`), or of a table. step(state, row) gives (state, rows to
    emit), end(state) what is emitted when the key times out, or at the end of the input. States must be JSON."""
    keys = [key] if isinstance(key, str) else list(key)
    names = [f.strip().split(" ")[0] for f in out.split(",")]
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {out}"

    def go(ks: tuple, state, pdf: pd.DataFrame) -> tuple[object, list[tuple]]:
        made = []
        for row in in_order([pdf], ["seq"]):
            state, rows = step(state, row)
            made += [(*ks, *r) for r in rows]
        return state, made

    def streaming(ks: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else begin()
        if held.hasTimedOut:
            made = [(*ks, *r) for r in (end(state) if end else [])]
            held.remove()
        else:
            got = list(pdfs)
            state, made = go(ks, state, got[0] if len(got) == 1 else pd.concat(got))
            held.update((json.dumps(state),))
            held.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(made, columns=[*keys, *names])

    def batch(ks: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, made = go(ks, begin(), pdf)
        return pd.DataFrame(made + [(*ks, *r) for r in (end(state) if end else [])], columns=[*keys, *names])

    if stream.isStreaming:
        made = stream.groupBy(*keys).applyInPandasWithState(streaming, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
        made._fold = Fold(keys, names, schema, end)
        return made
    return stream.groupBy(*keys).applyInPandas(batch, schema)


def committed_lines(chunks: DataFrame, key: str = "session") -> DataFrame:
    """(key, line_seq, line) from chunks (key, seq, text, rms, and if there is one: flush): see `folds.live_line`. What is
    pending at the end, or when a session times out, is a line of the last chunk."""
    flags = {"_credit": credit_line(F.col("text"))} | ({} if "flush" in chunks.columns else {"flush": F.lit(False)})

    def step(state, row):
        left, lines = folds.live_line(state[0], row["text"], row["rms"], bool(row["_credit"]), bool(row["flush"]))
        return [left, int(row["seq"])], [(row["seq"], x) for x in lines]

    return folded(chunks.withColumns(flags), key, "line_seq long, line string", lambda: ["", 0], step, lambda s: [(s[1], s[0])] if s[0] else [])


def buffered_captions(captions: DataFrame, key: str = "session") -> DataFrame:
    """(key, seen, line) from growing captions (key, seq, at in ms, text): see `folds.caption_buffer`. At the end, or after a
    time without captions, the rest is a line."""

    def step(state, row):
        state, lines = folds.caption_buffer(tuple(state), int(row["at"]), row["text"])
        return list(state), [(int(row["at"]), x) for x in lines]

    return folded(captions, key, "seen long, line string", lambda: ["", 0, 0], step, lambda s: [(s[2], s[0])] if s[0] else [])


def confirmed(hypotheses: DataFrame, key: str = "session") -> DataFrame:
    """(key, at_seq, n_committed, added, rest) after each hypothesis (key, seq, text, reset): how many words are committed by
    then, those that it added, and the rest of it; see `folds.confirmed_prefix`. The state is the last hypothesis and a
    number, and what was committed is said once."""

    def step(state, row):
        before, n = ([], 0) if row.get("reset") else state
        now, added, rest = folds.confirmed_prefix(before, n, row["text"])
        return [now, n + len(added)], [(row["seq"], n + len(added), " ".join(added), rest)]

    return folded(hypotheses, key, "at_seq long, n_committed long, added string, rest string", lambda: [[], 0], step)


def merged_fragments(fragments: DataFrame, key: str = "session", most: int = 12) -> DataFrame:
    """(key, at_seq, words, added): how many words a text has after each fragment (key, seq, text), and the words that it
    added; the state keeps the last `most` words only."""

    def step(state, row):
        n, tail = state
        new = (row["text"] or "").split()
        add = new[folds.words_overlap(tail, new, most) :]
        return [n + len(add), (tail + add)[-most:]], [(row["seq"], n + len(add), " ".join(add))]

    return folded(fragments, key, "at_seq long, words long, added string", lambda: [0, []], step)


def without_repeats(captions: DataFrame, key: str = "session", gap: float = 3.0) -> DataFrame:
    """(key, at_seq, caption) of captions (key, seq, at in s, text) that differ from the last one kept, or come `gap` seconds
    after it: a slow run of repeats is kept once in a while, which a comparison with the row before would not do."""

    def step(state, row):
        at = None if pd.isna(row["at"]) else float(row["at"])
        if not (row["text"] or "").strip() or not folds.kept_apart(tuple(state) if state else None, row["text"], at, gap):
            return state, []
        return [row["text"].lower(), at], [(row["seq"], row["text"])]

    return folded(captions, key, "at_seq long, caption string", lambda: None, step)


def active_changes(clock: DataFrame, cues: DataFrame, key: str = "session") -> DataFrame:
    """(key, at_seq, cue) whenever the cue shown changes: a clock (key, seq, at) meets the cues (key, cue, start, end) of its
    key (a join of stream and table), and a fold emits changes only; no cue is -1. Of overlapping cues the first counts."""
    at = clock.join(cues, key, "left").where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")) | F.col("start").isNull())
    if not clock.isStreaming:
        at = clock.join(at.groupBy(key, "seq").agg(F.min("cue").alias("cue")), [key, "seq"], "left")

    def step(state, row):
        cue = -1 if pd.isna(row["cue"]) else int(row["cue"])
        return cue, [(row["seq"], cue)] if cue != state else []

    return folded(at.select(key, "seq", "cue"), key, "at_seq long, cue long", lambda: None, step)


def final_rows(messages: DataFrame, key: str, record: str, keep_ms: int = KEEP_MS, every: bool = False) -> DataFrame:
    """(key, record, at_seq, text, translation): a record after each message (key, record, seq, stage, text, translation) that
    changes it, or with `every` after each that counts: previews never count, the first final makes the record, later ones replace what they bring, a blank
    translation replaces nothing. A record's state goes `keep_ms` after its last message; `latest` gives the last rows."""
    m = messages.where(~F.col("stage").contains("preview") & (F.col("stage") != "source"))

    def step(state, row):
        said = (row["translation"] or "").strip(" ")
        text = row["text"] if state is None else state[0]
        new = [text, said or (state[1] if state else None)]
        return new, [(row["seq"], *new)] if every or new != state else []

    return folded(m, [key, record], "at_seq long, text string, translation string", lambda: None, step, keep_ms=keep_ms)


def latest(rows: DataFrame, keys: list[str], by: str = "at_seq") -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("r")).select(*keys, "r.*")


def submitted_jobs(requests: DataFrame, key: str = "request_id", payload: str = "payload", keep_ms: int = KEEP_MS) -> DataFrame:
    """(key, at_seq, job) of requests: the first of an id is accepted, an equal one is known, one with another payload is a
    conflict. Payloads are compared by their digest; ids are forgotten after `keep_ms` without requests."""
    r = requests.withColumn("_print", F.sha2(payload, 256)).select(key, "seq", "_print")

    def step(state, row):
        if state is None:
            return row["_print"] or "", [(row["seq"], "accepted")]
        return state, [(row["seq"], "known" if (row["_print"] or "") == state else "conflict")]

    return folded(r, key, "at_seq long, job string", lambda: None, step, keep_ms=keep_ms)

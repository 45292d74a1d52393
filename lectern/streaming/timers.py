"""Timers in event time: captions that are still for a while, and sentences that a session's model takes one by one.

State is kept with transformWithState. A timer fires when the watermark has passed it, so what a stream emits depends on the
times of its rows, not on when they arrive or how they are dealt to micro-batches. A stream that ends should end with a row
of a later time (`closed`), so that the last timers fire too. Times are milliseconds after 1970, and not 0: there the
watermark begins, and a stream drops what is not past it."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectern.streaming.live import in_order

#: Milliseconds that a caption must be still: read from the page, and from a player (fixed values).
STILL_MS, PLAYER_STILL_MS = 280, 650
#: Times that a sentence is tried, milliseconds that the next try waits for each before, sentences of context (fixed values).
TRIES, BACK_OFF_MS, CONTEXT = 3, 1000, 8
#: Key of the row that closes a stream.
CLOCK = -1

#: (text, the sentences before it, which try) to a translation; None or blank: it failed.
Translate = Callable[[str, list[str], int], str | None]


class Timed(StatefulProcessor):
    """A key's state as JSON, moved on by rows in order of time and by its timer. Subclasses say how."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def begin(self) -> dict:
        raise TypeError("a subclass says how a state begins")

    def arrive(self, state: dict, row: dict, at: int) -> list[tuple]:
        """Rows to emit when a row of time `at` (ms) comes; everything due before is out."""
        raise TypeError("a subclass says what a row does")

    def due(self, state: dict, now: int) -> list[tuple]:
        """Rows to emit for what is due up to `now`."""
        raise TypeError("a subclass says what is due")

    def next(self, state: dict) -> int | None:
        """When something will be due, if anything."""
        raise TypeError("a subclass says when something is due")

    def folded(self, state: dict, rows: Iterable[dict]) -> list[tuple]:
        """What rows in order of time emit."""
        out = []
        for row in rows:
            at = int(row["at"])
            out += self.due(state, at) + self.arrive(state, row, at) + self.due(state, at)
        return out

    def _moved(self, key: tuple, state: dict, out: list[tuple]) -> Iterator[pd.DataFrame]:
        # A key has one timer at most; the state says which, since each question to the store is a round trip.
        at, was = self.next(state), state.get("timer")
        if at != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if at is not None:
                self.handle.registerTimer(at)
            state["timer"] = at
        self.state.update((json.dumps(state),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def _held(self) -> dict:
        held = self.state.get()
        return json.loads(held[0]) if held else self.begin()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._held()
        yield from self._moved(key, state, self.folded(state, in_order(list(rows), ["at", "seq"])))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._held()
        # The watermark is past this timer, and past what follows from it up to there.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        yield from self._moved(key, state, self.due(state, now))

    def close(self) -> None:
        pass


class Still(Timed):
    """Captions that stay for `wait` ms; a new one begins the time anew, one that is shown or waiting already does not. With
    `again`, new is what differs from the caption that came before it, so the one shown may come back and take the place of
    one that waits."""

    columns = ["session", "at", "caption"]

    def __init__(self, wait: int, again: bool = False):
        self.wait, self.again = wait, again

    def begin(self) -> dict:
        return {"shown": None, "text": None, "due": None}

    def arrive(self, state, row, at):
        text = " ".join((row["text"] or "").split())
        # What came last is waiting, or is shown if nothing waits.
        known = (state["shown"] if state["due"] is None else state["text"],) if self.again else (state["shown"], state["text"])
        if text and text not in known:
            state["text"], state["due"] = text, at + self.wait
        return []

    def due(self, state, now):
        if state["due"] is None or state["due"] > now:
            return []
        out = [(state["due"], state["text"])]
        state.update(shown=state["text"], text=None, due=None)
        return out

    def next(self, state):
        return state["due"]


class Queue(Timed):
    """Sentences of a session, translated one after the other, each tried up to TRIES times with a growing wait."""

    columns = ["session", "seq", "stage", "translation", "at"]

    def __init__(self, translate: Translate):
        self.translate = translate

    def begin(self) -> dict:
        return {"waiting": [], "tries": 0, "ready": 0, "context": []}

    def arrive(self, state, row, at):
        if not (row["text"] or "").strip():
            return []
        if not state["waiting"]:
            state["ready"] = max(state["ready"], at)
        state["waiting"].append([int(row["seq"]), row["text"], at])
        return [(int(row["seq"]), "source-final", "", at)]

    def due(self, state, now):
        out = []
        while state["waiting"] and state["ready"] <= now:
            seq, text, _ = state["waiting"][0]
            said = self.translate(text, state["context"], state["tries"])
            if not (said or "").strip():
                state["tries"] += 1
                if state["tries"] < TRIES:
                    state["ready"] += BACK_OFF_MS * state["tries"]
                    continue
            out.append((seq, "professional-final", said, state["ready"]) if (said or "").strip() else (seq, "error", "", state["ready"]))
            if (said or "").strip():
                state["context"] = [*state["context"], text][-CONTEXT:]
            state["waiting"].pop(0)
            state["tries"] = 0
            if state["waiting"]:
                state["ready"] = max(state["ready"], state["waiting"][0][2])
        return out

    def next(self, state):
        return state["ready"] if state["waiting"] else None


def _timed(rows: DataFrame, processor: Timed, out: str, late: str) -> DataFrame:
    if not rows.isStreaming:
        # A table: the same moves, in order of time, and then everything that is still due.
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            state = processor.begin()
            made = processor.folded(state, pdf.sort_values(["at", "seq"], kind="stable").to_dict("records"))
            while processor.next(state) is not None:
                made += processor.due(state, processor.next(state))
            return pd.DataFrame([(key[0], *r) for r in made], columns=processor.columns)

        return rows.select("session", "seq", "at", "text").groupBy("session").applyInPandas(run, out)
    marked = rows.select("session", "seq", "at", "text", F.timestamp_millis("at").alias("_time")).withWatermark("_time", late)
    made = marked.groupBy("session").transformWithStateInPandas(processor, StructType.fromDDL(out), "append", "EventTime")
    made._options = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    return made


def still_captions(captions: DataFrame, wait: int = STILL_MS, late: str = "1 second", again: bool = False) -> DataFrame:
    """(session, at, caption) of captions (session, seq, at in ms, text) that no other replaced for `wait` ms, at the time when
    that was sure; with `again`, a caption that is shown already replaces others too. Rows that come later than `late` are lost, as with any watermark."""
    return _timed(captions, Still(wait, again), "session long, at long, caption string", late)


def session_queue(sentences: DataFrame, translate: Translate, late: str = "1 second") -> DataFrame:
    """(session, seq, stage, translation, at) of sentences (session, seq, at in ms, text): first each as source-final, then as
    professional-final or error, in the order in which they came, at the time of the try that settled it."""
    return _timed(sentences, Queue(translate), "session long, seq long, stage string, translation string, at long", late)


def closed(rows: DataFrame, beyond_ms: int = 86_400_000) -> DataFrame:
    """rows (session, seq, at, text) of a table with one more, of the session CLOCK, `beyond_ms` after the last: the last step
    of a stream should have it."""
    last = rows.agg((F.coalesce(F.max("at"), F.lit(0)) + beyond_ms).alias("at"))
    clock = last.select(F.lit(CLOCK).cast("long").alias("session"), F.lit(0).cast("long").alias("seq"), F.col("at").cast("long").alias("at"), F.lit("").alias("text"))
    return rows.select("session", "seq", F.col("at").cast("long").alias("at"), "text").unionByName(clock)

"""Timers in event time: streams in steps give what the same rows give as a table, and what plain loops say."""
import random
import zlib

import pandas as pd
from lectern.streaming import live, timers
from pyspark.sql import functions as F

SCHEMA = "session long, seq long, at long, text string"


def feed(spark, rows, steps=4):
    """The rows in order of time, in steps, and a clock behind them."""
    df = timers.closed(spark.createDataFrame(rows, SCHEMA))
    top = max((r[2] for r in rows), default=0)
    return live.in_parts(df, "session", F.least(F.floor(F.col("at") * steps / (top + 1)), F.lit(steps)), steps + 1)


def got(df):
    return sorted(tuple(r) for r in df.where(F.col("session") != timers.CLOCK).collect())


def test_still_captions(spark):
    rng = random.Random(4)
    rows = []
    for k in range(5):
        at = 1000 * k + 1
        for i in range(40):
            at += rng.choice([20, 100, 279, 280, 281, 900])
            rows.append((k, i, at, rng.choice(["a", "b", " b ", "c d", None, ""])))
    want = []
    for k in range(5):
        shown = text = due = None
        for _, _, at, t in [r for r in rows if r[0] == k] + [(k, 99, 10**9, None)]:
            if due is not None and due <= at:
                want.append((k, due, text))
                shown, text, due = text, None, None
            t = " ".join((t or "").split())
            if t and t != shown and t != text:
                text, due = t, at + 280
    assert got(timers.still_captions(spark.createDataFrame(rows, SCHEMA))) == sorted(want) and len(want) > 20
    assert got(live.run_to_end(timers.still_captions(feed(spark, rows)), "still")) == sorted(want)


def translate(text, context, tries):
    k = zlib.crc32(text.encode()) % 5
    return None if k == 0 or (k == 1 and tries < 2) or (k == 2 and tries < 1) else f"{text}|{len(context)}|{tries}"


def test_session_queue(spark):
    rng = random.Random(5)
    rows = []
    for k in range(4):
        at = 1
        for i in range(30):
            at += rng.choice([0, 100, 700, 2500])
            rows.append((k, i, at, f"s{k}-{i}" if rng.random() > 0.1 else " "))
    want = []
    for k in range(4):
        free, context = 0, []
        for _, i, at, text in [r for r in rows if r[0] == k and r[3].strip()]:
            want.append((k, i, "source-final", "", at))
            free = max(free, at)
            for tries in range(3):
                said = translate(text, context, tries)
                if said or tries == 2:
                    break
                free += 1000 * (tries + 1)
            want.append((k, i, "professional-final", said, free) if said else (k, i, "error", "", free))
            context = (context + [text])[-8:] if said else context
    assert got(timers.session_queue(spark.createDataFrame(rows, SCHEMA), translate)) == sorted(want)
    assert {w[2] for w in want} == {"source-final", "professional-final", "error"}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert got(live.run_to_end(timers.session_queue(feed(spark, rows), translate), "queue")) == sorted(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert got(timers.session_queue(spark.createDataFrame([], SCHEMA), translate)) == []


def test_a_key_asks_the_store_for_no_timers():
    import json

    from lectern.streaming import timers as T

    class Store:
        asked, held, timers = [], None, set()

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def listTimers(self):
            self.asked.append("list")
            return list(self.timers)

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    q, s = T.Still(100), Store()
    q.handle = q.state = s
    rows = lambda *r: iter([pd.DataFrame(r, columns=["seq", "at", "text"])])
    list(q.handleInputRows((1,), rows((1, 1000, "a")), None))
    assert s.timers == {1100}
    list(q.handleInputRows((1,), rows((3, 1080, "c"), (2, 1050, "b")), None))
    assert s.timers == {1180} and json.loads(s.held[0])["text"] == "c" and not s.asked

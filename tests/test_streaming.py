"""Streaming operators against plain folds: files as source, several micro-batches, run to the end of their input."""
import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from lectern.streaming import folds, live


def feed(spark, tmp_path, rows, columns, schema, parts=3):
    """A stream over `parts` files that hold the rows in order."""
    src = tmp_path / "in"
    for i in range(parts):
        some = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def got(df, *by):
    return sorted(tuple(r) for r in df.collect())


def test_lines_commit_flush_and_credits(spark, tmp_path):
    rng = random.Random(1)
    words = ["bond", "yields.", "rise", "thanks for watching", "", None, "z" * 90, "www.site.com"]
    rows = [(k, i, rng.choice(words), rng.choice([0.0, 0.0005, 0.5, 0.5]), i % 13 == 12 and i < 52) for i in range(60) for k in (1, 2)]
    schema = "session long, seq long, text string, rms double, flush boolean"
    out = live.run_to_end(live.committed_lines(feed(spark, tmp_path, rows, None, schema)), "lines")
    want = []
    for k in (1, 2):
        pending = ""
        for _, i, t, rms, flush in [r for r in rows if r[0] == k]:
            credit = t in ("thanks for watching", "www.site.com")
            pending, lines = folds.live_line(pending, t, rms, credit, flush)
            want += [(k, i, x) for x in lines]
        want += [(k, 59, pending)] if pending else []
    assert got(out) == sorted(want) == got(live.committed_lines(spark.createDataFrame(rows, schema))) and len(want) > 20
    assert any("bond" in x for *_, x in want)


def test_line_rules():
    assert folds.live_line("tail", None, 0.0) == ("", ["tail"]) and folds.live_line("", "x", 0.0) == ("", [])
    assert folds.live_line("a", "subscribe", 0.0005, credit=True) == ("a", []) and folds.live_line("a", "subscribe", 0.5, credit=True) == ("a subscribe", [])
    assert folds.live_line("a", "b.", 0.5) == ("", ["a b."]) and folds.live_line("", "y" * 160, 0.5) == ("", ["y" * 160])


def test_confirmed_prefixes(spark, tmp_path):
    rows = [(1, 0, "prices rise", False), (1, 1, "Prices rise fast", False), (1, 2, "prices fall", False), (1, 3, "prices fall now", False), (1, 4, None, False), (1, 5, "new talk", True), (1, 6, "new talk show", False)]
    schema = "session long, seq long, text string, reset boolean"
    want = [(1, 0, 0, "", "prices rise"), (1, 1, 2, "Prices rise", "fast"), (1, 2, 2, "", ""), (1, 3, 2, "", "now"), (1, 4, 2, "", ""), (1, 5, 0, "", "new talk"), (1, 6, 2, "new talk", "show")]
    assert got(live.run_to_end(live.confirmed(feed(spark, tmp_path, rows, None, schema)), "prefix")) == want


def test_caption_buffer(spark, tmp_path):
    rows = [(1, 0, 0, "we saw"), (1, 1, 500, "we saw the"), (1, 2, 900, "the red boat"), (1, 3, 4000, "it sails."), (1, 4, 5000, "a"), (1, 5, 7000, "b"), (1, 6, 9000, "c"), (1, 7, 11000, "d"), (1, 8, 12000, "e")]
    schema = "session long, seq long, at long, text string"
    table = got(live.buffered_captions(spark.createDataFrame(rows, schema)))
    assert table == [(1, 4000, "it sails."), (1, 4000, "we saw the red boat"), (1, 11000, "a b c d"), (1, 12000, "e")]
    stream = got(live.run_to_end(live.buffered_captions(feed(spark, tmp_path, rows, None, schema)), "buffer"))
    assert stream == table  # the last line comes from the state
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    assert folds.merge_caption("The red", "the RED boat") == "the RED boat" and folds.merge_caption("a b c", "B C") == "a b c" and folds.merge_caption(None, "x") == "x"


def test_repeats_fragments_jobs_and_clock(spark, tmp_path):
    rows = [(1, i, float(2 * i), "same") for i in range(6)] + [(1, 6, None, "Same"), (1, 7, 20.0, "other"), (1, 8, 20.5, None)]
    schema = "session long, seq long, at double, text string"
    assert got(live.run_to_end(live.without_repeats(feed(spark, tmp_path, rows, None, schema)), "repeats")) == [(1, 0, "same"), (1, 2, "same"), (1, 4, "same"), (1, 7, "other")]
    text = [f"w{i}" for i in range(100)]
    parts = [(1, i, " ".join(text[6 * i : 6 * i + 10]), False) for i in range(15)]
    merged = live.run_to_end(live.merged_fragments(feed(spark, tmp_path / "m", parts, None, "session long, seq long, text string, x boolean")), "merged").orderBy("at_seq").collect()
    assert " ".join(r["added"] for r in merged) == " ".join(text[:94]) and merged[-1]["words"] == 94
    jobs = [("a", 0, "p"), ("a", 1, "p"), ("b", 2, "p"), ("a", 3, "q"), ("b", 4, None)]
    out = got(live.run_to_end(live.submitted_jobs(feed(spark, tmp_path / "j", jobs, None, "request_id string, seq long, payload string")), "jobs"))
    assert out == [("a", 0, "accepted"), ("a", 1, "known"), ("a", 3, "conflict"), ("b", 2, "accepted"), ("b", 4, "conflict")]
    cues = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 4.0, 6.0), (1, 2, 8.0, 9.0)], "session long, cue long, start double, end double")
    clock = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 1.0, 4.5, 5.5, 7.0, 7.5, 8.0])], "session long, seq long, at double")
    assert got(live.active_changes(clock, cues)) == [(1, 0, 0), (1, 3, 1), (1, 4, -1), (1, 6, 2)]


def test_late_finals_update_their_record(spark, tmp_path):
    rows = [(1, "r", 0, "source-final", "text", ""), (1, "r", 1, "preview", "text", "pre"), (1, "r", 2, "final", "text2", "done"), (1, "r", 3, "final", "text2", " "), (1, "s", 4, "source", "x", "y")]
    schema = "session long, record string, seq long, stage string, text string, translation string"
    out = live.run_to_end(live.final_rows(feed(spark, tmp_path, rows, None, schema), "session", "record"), "finals")
    assert got(out) == sorted([(1, "r", 0, "text", None), (1, "r", 2, "text", "done")]) and got(live.latest(out, ["session", "record"])) == [(1, "r", 2, "text", "done")]


def test_windows_and_sessions(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=m), m % 2) for m in (0, 10, 70, 71, 200, 205, 400)]
    events = feed(spark, tmp_path, rows, None, "ts timestamp, k int")
    w = live.run_to_end(live.windowed(events, "ts", "1 hour", ["k"], [F.count("*").alias("n")]), "windows", "complete")
    assert sorted((r["start"].hour, r["k"], r["n"]) for r in w.collect()) == [(0, 0, 2), (1, 0, 1), (1, 1, 1), (3, 0, 1), (3, 1, 1), (6, 0, 1)]
    s = live.run_to_end(live.sessions(events, "ts", "30 minutes", ["k"], [F.count("*").alias("n")]), "sessions", "complete")
    assert sorted(r["n"] for r in s.collect()) == [1, 1, 1, 1, 1, 2]


def test_rows_of_a_key_in_order():
    a, b = pd.DataFrame({"seq": [3, 1], "text": ["x", None]}), pd.DataFrame({"seq": [1, 2], "text": ["y", "z"]})
    assert live.in_order([a, b], ["seq"]) == [{"seq": 1, "text": None}, {"seq": 1, "text": "y"}, {"seq": 2, "text": "z"}, {"seq": 3, "text": "x"}]
    assert [r["text"] for r in live.in_order([pd.DataFrame({"seq": [None, 2.0, 1.0], "text": ["n", "b", "a"]})], ["seq"])] == ["a", "b", "n"]

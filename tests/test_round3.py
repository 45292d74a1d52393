"""Cases of the third round of findings: each would have failed before."""
import duckdb

from lectern.functions import addresses as A
from lectern.functions import quality as Y
from lectern.operators import links as L
from lectern.plans.catalogue import ORACLES, QUERIES
from lectern.streaming import timers
from pyspark.sql import functions as F


def test_publishers_compare_an_address_once(spark):
    # The compared form stands once in the plan, and not in each rule; rules give what they gave.
    c = L.publisher_candidates(F.col("u"))
    df = spark.createDataFrame([("HTTPS://www.MDPI.com:443/1/2",), ("https://ieeexplore.ieee.org/x?arnumber=7",), ("https://x.org/doi/10.1/2",), (None,)], "u string").select(c.alias("c"))
    assert [r["c"] for r in df.collect()] == [["https://www.mdpi.com/1/2/pdf"], ["https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=7"], [], []]
    lowered = lambda x: x._jdf.queryExecution().analyzed().toString().count("lower(")
    assert lowered(df) == lowered(spark.range(1).select(A.plain_form(F.lit("http://x")).alias("c")))


def test_signals_of_logic_have_ascii_edges(spark):
    df = spark.createDataFrame([("das m\u00fcno here",), ("knot",), ("\u4e2dnot\u6587",), ("is not",), ("no_t",)], "x string")
    got = [[s["signal"] for s in r["s"]] for r in df.select(Y.logic_signals(F.col("x"), F.lit("\u4e0d")).alias("s")).collect()]
    assert got == [["negation"], [], ["negation"], ["negation"], []]
    refs = df.sparkSession.createDataFrame([("\u53c2\u8003\u6587\u732e x",), ("\u53c2\u8003\u6587\u732eA",), ("references\u00e9",)], "x string")
    want = [duckdb.execute("select regexp_matches(?, ?)", [r["x"], Y.REFERENCES]).fetchall()[0][0] for r in refs.collect()]
    assert [r["b"] for r in refs.select(Y.bibliography(F.col("x")).alias("b")).collect()] == want == [False, True, True]


def test_shown_captions_replace_those_that_wait(spark, tmp_path):
    # a is shown, b waits, a comes back within the wait: b is not shown, and a is again.
    rows = [(1, 0, 1, "a"), (1, 1, 5000, "b"), (1, 2, 5300, "a"), (1, 3, 5400, "a"), (1, 4, 9000, "b"), (1, 5, 9650, "a")]
    df = spark.createDataFrame(rows, "session long, seq long, at long, text string")
    assert sorted(tuple(r) for r in timers.still_captions(df, 650, again=True).collect()) == [(1, 651, "a"), (1, 5950, "a"), (1, 9650, "b"), (1, 10300, "a")]
    spark.createDataFrame(rows, "user_id long, event_id long, ms long, event_type string").select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["stream_still_captions"]).fetchall())
    assert sorted((r["session"], r["at"], r["caption"]) for r in QUERIES["stream_still_captions"](spark, str(tmp_path)).collect()) == want and len(want) == 4


def test_final_rows_say_their_last_message(spark, tmp_path):
    # The second turn changes nothing, and is the last of the record all the same; the fifth is a preview.
    spark.createDataFrame([(1, t, "user", f"x{t}") for t in (0, 1, 3, 4, 6, 8)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["stream_final_rows"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["stream_final_rows"](spark, str(tmp_path)).collect()) == want and [w[-1] for w in want] == [1, 3, 8]


def test_pages_cost_no_frame_of_their_own(spark):
    # Folds read sorted partitions, so that a page costs its rows; a page that straddles Arrow batches is whole.
    from lectern.operators import layout, pages

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(doc, 0, k, f"word{k}", 40.0 * (k % 5), 40.0 * (k % 5) + 38, 38.0, 20.0 * (k // 5), 20.0 * (k // 5) + 11, 20.0 * (k // 5) + 10, 10.0) for doc in range(9) for k in range(20)]
        tokens = spark.createDataFrame(rows, "doc long, page long, ord long, text string, x double, right double, width double, y double, bottom double, baseline double, font double")
        got = pages.lines(tokens.drop("ord"), 900.0)
        assert sorted((r["doc"], r["line"], r["text"]) for r in got.collect()) == [(doc, n + 1, " ".join(f"word{5 * n + i}" for i in range(5))) for doc in range(9) for n in range(4)]
        blocks = tokens.select("doc", "page", F.col("ord").alias("block"), "text", "x", "y", "width", F.lit(18.0).alias("height"))
        for made in (got, pages.blocks(got, 900.0), layout.column_bands(blocks, 900.0), layout.in_reading_order(blocks, 900.0)):
            assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
        assert layout.in_reading_order(blocks, 900.0).count() == 180
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_normal_forms_hold_few_texts_at_a_time(spark):
    from lectern.functions import normal

    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"ﬁne Å {i}" if i % 2 else f"plain {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x string").coalesce(1)
    got = df.select("i", normal.normal_source(F.col("x")).alias("y"))
    assert {r["i"]: r["y"] for r in got.collect()} == {i: x if x is None else normal.normal_source_of(x) for i, x in rows}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and normal.SLICE < 300
    # The function takes Arrow's own arrays, so that no batch is a column of strings.
    import pyarrow as pa

    assert normal._form("NFKC", True).func(pa.array(["ﬁ", None])).to_pylist() == ["fi", None]


def test_requests_are_held_in_slices(spark):
    from lectern.operators import batches

    def run(pdfs):
        for pdf in pdfs:
            yield pdf.assign(n=[len(pdf)] * len(pdf))

    rows = [(None if i == 3 else i, f"x{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "pos long, text string").coalesce(1)
    got = [tuple(r) for r in batches.in_slices(df, run, "pos long, text string, n int").collect()]
    assert [r[:2] for r in got] == rows and sorted({r[2] for r in got}) == [22, 64]

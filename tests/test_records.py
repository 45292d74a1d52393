from pyspark.sql import functions as F

from lectern.operators import providers
from lectern.operators import sequences as O
from lectern.operators.numbering import number_rows
from lectern.sources.captions import origin, parse_captions


def test_captions(spark):
    vtt = "WEBVTT\n\nNOTE made\n\n00:01.200 --> 00:02.130 align:start\nHello <b>x</b> &amp; y\n\n00:00:02,500 --> 00:00:04,010\nNext\n\n00:05.000 --> 00:04.000\ninverted"
    rows = parse_captions(spark.createDataFrame([(1, vtt), (2, "WEBVTT\n\nNOTE only"), (3, None)], "k int, text string"), "k", "text").orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(1.2, 2.13, "Hello x & y"), (2.5, 4.01, "Next")]


def test_batches_keep_order_and_limits(spark):
    rows = spark.createDataFrame([(k, i, "x" * (i * 37 % 90)) for k in range(3) for i in range(40)], "k int, i int, t string")
    got = O.greedy_batches(rows, "k", "i", F.length("t"), 5, 200).toPandas()
    for _, g in got.sort_values(["k", "i"]).groupby("k"):
        batch, n, size = -1, 0, 0
        for i, b in zip(g["i"], g["batch"], strict=True):
            s = i * 37 % 90
            if batch < 0 or n >= 5 or size + s > 200:
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + s
            assert b == batch


def test_asof_and_interval(spark):
    lines = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 20)], "k string, t double, v long")
    probes = spark.createDataFrame([("a", 0.5, 1), ("a", 1.0, 2), ("a", 9.0, 3), ("b", 1.0, 4)], "k string, t double, p long")
    got = {r["p"]: r["found"] for r in O.asof_backward(probes, lines, "k", "t", "v", "p").collect()}
    assert got == {1: None, 2: 10, 3: 20, 4: None}
    spans = spark.createDataFrame([(1, 0.0, 95.0), (2, 10.0, 10.0), (3, 20.0, 21.0)], "s int, a double, b double")
    points = spark.createDataFrame([(0.0,), (20.5,), (95.0,)], "at double")
    assert sorted((r["at"], r["s"]) for r in O.in_interval(points, spans, "at", "a", "b", 10.0).collect()) == [(0.0, 1), (20.5, 1), (20.5, 3)]


def test_merge_keeps_old_where_new_is_blank(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, ""), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in O.merge_snapshots(old, new, ["k"], "v").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_numbers_are_dense(spark):
    rows = spark.range(0, 1000, numPartitions=7).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r["number"] == r["x"] + 1 for r in number_rows(rows, ["x"]).collect())


def test_origin(spark):
    rows = spark.createDataFrame([("HTTPS://A.com:443/x?y",), ("http://b.org:8080/",)], "u string").select(origin(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["https://a.com", "http://b.org:8080"]


def test_provider_passes(spark):
    providers.register("odd", lambda texts, s, t: [None if "bad" in x else x[::-1] for x in texts])
    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, " "), (4, None)], "k int, text string")
    got = {r["k"]: (r["translation"], r["error"]) for r in providers.translate(rows, "text", "en", "zh", lambda x, s, t: [None if "bad" in y else y[::-1] for y in x]).collect()}
    assert got[1] == ("cba", None) and got[2] == ("bad", "failed") and got[3][1] is None

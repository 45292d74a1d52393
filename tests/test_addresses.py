"""Addresses against the standard library and the examples of RFC 3986."""
from urllib.parse import urljoin

from pyspark.sql import functions as F

from lectern.functions import addresses as A

RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
}


def test_resolution(spark):
    rows = [("http://a/b/c/d;p?q", r, w) for r, w in RFC.items()]
    bases, refs = ["http://h.x", "https://h.x/a/b?c#d", "http://h.x/a/"], ["p", "/p/../q", "//o.y/z", "q?r=1", "../../x", "https://z/", "a/b", "é/ü"]
    rows += [(b, r, urljoin(b, r)) for b in bases for r in refs] + [(None, "x", None), ("http://a/", None, None)]
    got = spark.createDataFrame(rows, "base string, ref string, want string").withColumn("got", A.resolved(F.col("base"), F.col("ref"))).collect()
    assert [(r["base"], r["ref"], r["got"]) for r in got] == rows


def test_tags_and_attributes(spark):
    html = "<!-- <link rel=a> --><script>'<link rel=b>'</script><LINK Rel=\"c d\" title='rel=x' href='/p?a=1&amp;b=2'><linked rel=e><link\nhref=q/r rel=f><link data-rel=n><link rel='open>"
    df = spark.createDataFrame([(html,), ("<link " * 20_000,), ('<link a="' * 20_000,), ("<!--" * 20_000,), (None,)], "h string")
    x = df.select(F.transform(A.tags(F.col("h"), "link"), lambda t: F.struct(A.attribute(t, "rel").alias("rel"), A.attribute(t, "href").alias("href"))).alias("t")).collect()
    assert [tuple(t) for t in x[0]["t"]] == [("c d", "/p?a=1&b=2"), ("f", "q/r"), (None, None), ("'open", None)]
    assert x[4]["t"] is None and x[3]["t"] == []


def test_forms(spark):
    df = spark.createDataFrame([("HTTP://Ex.Org:80", "http://ex.org/"), ("https://a.b:443/C?d#e", "https://a.b/C?d"), ("https://a.b:80/", "https://a.b:80/")], "u string, w string")
    assert all(r["w"] == r["g"] for r in df.withColumn("g", A.plain_form(F.col("u"))).collect())
    s = spark.createDataFrame([("a.b.c",), ("c",), (".c",), ("",)], "h string").select(A.suffixes(F.col("h"), 3).alias("s")).collect()
    assert [r["s"] for r in s] == [["c", "b.c", "a.b.c"], ["c"], ["c", ".c"], [""]]

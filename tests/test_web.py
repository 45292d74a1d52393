"""Text nodes, links to documents and publishers' addresses on small pages."""
import time

from lectern.operators import links as L
from lectern.sources import markup
from pyspark.sql import functions as F


def test_text_nodes(spark):
    page = """<html><head><title>t t</title><script>var a = "<p>no</p>";</script></head><body><nav>menu words</nav>
    <main><h1>Head &amp; line</h1><p>first <b>bold</b> tail<p>second<ul><li>one a<li>two b</ul><code>x = 1</code><p hidden>gone</p><div style="display: none"><p>gone too</p></div>
    <div aria-hidden=true>gone <i>as well</i></div><div contenteditable>edit</div><div contenteditable="false">kept one</div><p>12.5 %</p><p>x</p><br>after break</main><p>outside main</p></body></html>"""
    rows = [(1, page), (2, "<p>no root here<p>and more"), (3, None), (4, ""), (5, "<article>in</article><main>not in the first</main>")]
    n = markup.text_nodes(spark.createDataFrame(rows, "page_id long, html string"))
    got = {k: [(r["text"].strip(), r["path"]) for r in markup.readable_nodes(n).where(F.col("page_id") == k).orderBy("node").collect()] for k in range(1, 6)}
    assert [x for x, _ in got[1]] == ["Head & line", "first", "bold", "tail", "second", "one a", "two b", "kept one", "after break"]
    assert dict(got[1])["two b"] == "/html[1]/body[1]/main[1]/ul[1]/li[2]" or dict(got[1])["two b"].endswith("/ul[1]/li[2]")
    assert dict(got[1])["bold"].endswith("/p[1]/b[1]") and [x for x, _ in got[2]] == ["no root here", "and more"] and got[3] == got[4] == [] and [x for x, _ in got[5]] == ["in"]
    assert n.where("page_id = 1 and text = 'bold'").first()["depth"] >= 4
    began = time.perf_counter()
    for odd in ("<div>" * 30_000 + "</b>" * 30_000, "<p>" * 60_000, "<a x='" * 20_000):
        markup.nodes_of(odd)
    assert time.perf_counter() - began < 30


def test_document_links(spark):
    html = """<meta property="og:pdf" content="//cdn.x.org/a.pdf"><a href='b/c.PDF#p2'>x</a><a data-href="/no.pdf">y</a><link href="style.css?pdf=/pdf/"><object data="https://x.org/stamp.jsp?a=1">
    <script>var u = "https:\\/\\/x.org\\/d\\/epdf\\/1";</script> see /articles/9/pdf or ftp://x.org/z.pdf <a href="b/c.PDF">again</a> javascript:void('/pdf')"""
    rows = [(1, "https://www.x.org/p/q?r", html), (2, "https://x.org", None), (3, None, "<a href=/a.pdf>"), (4, "http://y.org/", "".join(f"<a href=/{i}.pdf>" for i in range(40)))]
    got = {}
    for r in L.document_links(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["link"])
    assert got[1][:3] == ["https://cdn.x.org/a.pdf", "https://www.x.org/p/b/c.PDF", "https://x.org/stamp.jsp?a=1"] and "https://x.org/d/epdf/1" in got[1] and "https://www.x.org/articles/9/pdf" in got[1]
    assert len(got[1]) == len(set(got[1])) and not any("style.css" in x for x in got[1])
    assert got[4] == [f"http://y.org/{i}.pdf" for i in range(L.MOST_LINKS)] and set(got) == {1, 4}


def test_publishers(spark):
    cases = {
        "https://pubs.acs.org/doi/full/10.1021/x?y=1": ["https://pubs.acs.org/doi/epdf/10.1021/x?y=1", "https://pubs.acs.org/doi/pdf/10.1021/x?y=1", "https://pubs.acs.org/doi/pdf/10.1021/x?download=true"],
        "https://www.tandfonline.com/doi/10.1/z": ["https://www.tandfonline.com/doi/pdf/10.1/z?download=true", "https://www.tandfonline.com/doi/pdf/10.1/z"],
        "https://www.sciencedirect.com/science/article/pii/S12?via=1": ["https://www.sciencedirect.com/science/article/pii/S12/pdfft?isDTMRedir=true&download=true"],
        "https://link.springer.com/article/10.1007/s1": ["https://link.springer.com/content/pdf/10.1007/s1.pdf"],
        "https://a.link.springer.com/article/10.1007/s1": [],
        "https://www.nature.com/articles/s41/": ["https://www.nature.com/articles/s41.pdf"],
        "https://www.nature.com/articles/s41.pdf": [],
        "https://iopscience.iop.org/article/10.1088/1/meta": ["https://iopscience.iop.org/article/10.1088/1/pdf"],
        "https://pubs.rsc.org/en/content/articlelanding/2020/x": ["https://pubs.rsc.org/en/content/articlepdf/2020/x"],
        "https://ieeexplore.ieee.org/document/123/": ["https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=123"],
        "https://ieeexplore.ieee.org/stamp.jsp?arnumber=77": ["https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=77"],
        "https://www.mdpi.com/1/2/": ["https://www.mdpi.com/1/2/pdf"],
        "https://www.mdpi.com/1/2/pdf": [],
        "https://www.frontiersin.org/articles/10.3/full": ["https://www.frontiersin.org/articles/10.3/pdf"],
        "https://arxiv.org/abs/2101.1": ["https://arxiv.org/pdf/2101.1.pdf"],
        "https://other.org/doi/10.1/z": [],
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("c", L.publisher_candidates(F.col("u")))
    assert {r["u"]: r["c"] for r in df.collect()} == cases

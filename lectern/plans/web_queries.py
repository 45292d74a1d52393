"""Queries on web pages: text nodes, documents that they link to, publishers' addresses."""
from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import links as L
from lectern.plans.registry import query, t
from lectern.sources import markup

_INNER = "regexp_extract(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<article[^>]*>(.*?)</article>', 1)"


@query(
    f"with n as (select page_id, unnest(string_split_regex({_INNER}, '<[^>]*>')) x from pages), d as (select page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '^\\s+|\\s+$', '', 'g')) x from n) "
    "select page_id, cast(count(*) as bigint) nodes, cast(sum(length(x)) as bigint) chars from d where length(x) >= 2 and not regexp_matches(x, '^[0-9\\s.,;:()\\[\\]{}+\\-–—=<>/%°×·|]+$') group by page_id"
)
def readable_text_nodes(spark, d):
    n = markup.readable_nodes(markup.text_nodes(t(spark, d, "pages")))
    return n.groupBy("page_id").agg(F.count("*").alias("nodes"), F.sum(F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("chars"))


_DIR = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"


@query(
    f"with p as (select page_id, regexp_extract({_DIR}, '^([a-z]+://[^/]*)', 1) host, {_DIR} dir, regexp_replace({_DIR}, '^[a-z]+://[^/]*', '') path from pages) "
    "select page_id, cast(pos as bigint) pos, link from (select page_id, unnest([0, 1, 2, 3]) pos, unnest([host || '/meta/' || page_id || '.pdf?a=1&b=2', case when path = '/' then host || '/' else host || regexp_replace(path, '[^/]+/$', '') end || 'p' || page_id || '.pdf', dir || 'pdf/' || page_id, case when path <> '/' and regexp_replace(path, '[^/]+/$', '') <> '/' then host || '/p' || page_id || '.pdf' end]) link from p) where link is not null"
)
def page_documents(spark, d):
    """Each page with a document in its metadata, two in its links, and others that are none. What follows the dots of a
    relative link is read as an address of its own too, as running text is."""
    i = F.col("page_id").cast("string")
    head = F.concat(F.lit("<meta content='/meta/"), i, F.lit(".pdf?a=1&amp;b=2#x' name=citation_pdf_url><meta name=other content=/no.pdf.js>"))
    tail = F.concat(F.lit('<a class="pdf" href="../p'), i, F.lit('.pdf#page=2">x</a><a href=/style.pdf.css><iframe src=pdf/'), i, F.lit("></iframe>"))
    return L.document_links(t(spark, d, "pages").select("page_id", "url", F.concat(head, tail, F.regexp_replace("html", "[/.]", " ")).alias("html")))


_P = "(['onlinelibrary.wiley.com/doi/abs/10.1002/a.' || i, 'www.mdpi.com/1/' || i, 'arxiv.org/abs/' || i || 'v2', 'x.org/doi/10.1/' || i])[1 + i % 4]"


@query(
    f"with u as (select o_orderkey, o_orderkey // 7 i from orders), a as (select o_orderkey, i, 'https://' || {_P} u from u), "
    "c as (select o_orderkey, case i % 4 when 0 then ['https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/a.' || i, 'https://onlinelibrary.wiley.com/doi/pdf/10.1002/a.' || i] when 1 then ['https://www.mdpi.com/1/' || i || '/pdf'] when 2 then ['https://arxiv.org/pdf/' || i || 'v2.pdf'] else [] end c from a) select o_orderkey, cast(unnest(range(0, len(c))) as bigint) pos, unnest(c) as address from c"
)
def publisher_documents(spark, d):
    """Order numbers in the addresses of four publishers."""
    i = F.floor(F.col("o_orderkey") / 7).cast("string")
    kind = F.floor(F.col("o_orderkey") / 7) % 4
    u = F.when(kind == 0, F.concat(F.lit("onlinelibrary.wiley.com/doi/abs/10.1002/a."), i)).when(kind == 1, F.concat(F.lit("www.mdpi.com/1/"), i)).when(kind == 2, F.concat(F.lit("arxiv.org/abs/"), i, F.lit("v2"))).otherwise(F.concat(F.lit("x.org/doi/10.1/"), i))
    c = L.publisher_candidates(F.concat(F.lit("https://"), u))
    return t(spark, d, "orders").select("o_orderkey", F.posexplode(c).alias("pos", "address")).withColumn("pos", F.col("pos").cast("long"))

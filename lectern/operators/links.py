"""Addresses of documents that pages name: in metadata, tags and running text, resolved; and those that a publisher's own
address stands for, by rules on host and path. All of it is columns of one page; nothing is shuffled.

Defined results: a null page has no links; addresses that are not http(s) are none; of equal addresses the first counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import addresses as A

#: Links of a page that are kept, in their order (a fixed value of the rule).
MOST_LINKS = 16
#: Names of metadata with a document's address, addresses in running text, what tells a document, and what none.
META = r"(?i)^(citation_pdf_url|wkhealth_pdf_url|pdf_url|og:pdf)$"
RAW = r"(?i)(?:https?:)?(?:\\?/){2}[^\s\"'<>]+|(?:\\?/)[^\s\"'<>]*(?:pdfdirect|articlepdf|pdfft|getPDF\.jsp|\.pdf|/pdf)[^\s\"'<>]*"
ASSET = r"\.(?:js|css|png|jpe?g|gif|svg|woff2?)(?:[?#]|$)"
DOCUMENT = r"(?:\.pdf(?:$|[?#])|/pdf(?:direct)?(?:/|$|\?)|/epdf(?:/|$|\?)|articlepdf|pdfft|getpdf\.jsp|stamp\.jsp)"
#: Fixed values: (host ends with, host exactly, pattern of the path, new path, query: None, "own" or the text itself). A DOI's
#: route may have a word before the DOI.
DOI = r"(?i)^/doi/(?:epdf|full|abs|pdfdirect|pdf)?/?(10\..+)$"
PUBLISHERS = (
    ("onlinelibrary.wiley.com", False, DOI, "/doi/pdfdirect/$1", None),
    ("onlinelibrary.wiley.com", False, DOI, "/doi/pdf/$1", None),
    ("tandfonline.com", False, DOI, "/doi/pdf/$1", "?download=true"),
    ("tandfonline.com", False, DOI, "/doi/pdf/$1", None),
    ("pubs.acs.org", False, DOI, "/doi/epdf/$1", "own"),
    ("pubs.acs.org", False, DOI, "/doi/pdf/$1", "own"),
    ("pubs.acs.org", False, DOI, "/doi/pdf/$1", "?download=true"),
    ("science.org", False, DOI, "/doi/pdf/$1", None),
    ("aip.org", False, DOI, "/doi/pdf/$1", None),
    ("sciencedirect.com", False, r"(?i)^.*?/science/article/pii/([^/]+).*$", "/science/article/pii/$1/pdfft", "?isDTMRedir=true&download=true"),
    ("link.springer.com", True, r"(?i)^/(?:article|chapter)/(10\..+)$", "/content/pdf/$1.pdf", None),
    ("nature.com", False, r"(?i)^(/articles/(?![^/]+\.pdf$)[^/]+?)/?$", "$1.pdf", None),
    ("iopscience.iop.org", False, r"(?i)^/article/(10\..+?)(?:/meta|/pdf)?$", "/article/$1/pdf", None),
    ("rsc.org", False, r"^(.*?)/content/articlelanding/(.*)$", "$1/content/articlepdf/$2", None),
    ("ieee.org", False, r"^.*?/document/([0-9]+).*$", "/stampPDF/getPDF.jsp", "?tp=&arnumber=$1"),
    ("mdpi.com", False, r"(?i)^(?!.*/pdf/?$)(.*?)/?$", "$1/pdf", None),
    ("frontiersin.org", False, r"(?i)^(.*)/full/?$", "$1/pdf", None),
    ("arxiv.org", False, r"(?i)^/abs/(.*)$", "/pdf/$1.pdf", None),
)


def is_document(url: Column) -> Column:
    """Whether an address looks like a document's, by its path and query."""
    x = F.lower(F.concat(A.part(url, A.PATH), A.part(url, A.QUERY)))
    return ~x.rlike(ASSET) & x.rlike(DOCUMENT)


def document_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most: int = MOST_LINKS) -> DataFrame:
    """(key, pos, link): documents that a page links to, numbered from 0: first those in metadata, then those of tags, then
    those in running text and scripts; resolved against the page, without fragments, each once."""
    h = F.col("_h")
    own = pages.select(key, F.col(url).alias("_u"), F.coalesce(F.col(html), F.lit("")).alias("_h"))
    metas = F.filter(F.regexp_extract_all(h, F.lit(r"(?i)<meta\b[^>]*+>"), F.lit(0)), lambda x: F.coalesce(F.nullif(A.attribute(x, "name"), F.lit("")), A.attribute(x, "property"), F.lit("")).rlike(META))
    tags = F.regexp_extract_all(h, F.lit(r"(?i)<(?:a|link|iframe|embed|object)\b[^>]*+>"), F.lit(0))
    named = lambda x: F.coalesce(*[F.nullif(A.attribute(x, n), F.lit("")) for n in ("href", "src", "data")])
    raw = F.transform(F.regexp_extract_all(h, F.lit(RAW), F.lit(0)), A.unescaped)
    found = F.concat(F.transform(metas, lambda x: A.attribute(x, "content")), F.transform(tags, named), raw)
    e = own.select(key, "_u", F.posexplode(F.filter(found, lambda x: F.coalesce(x, F.lit("")) != "")).alias("_i", "_r"))
    full = F.regexp_replace(A.resolved(F.col("_u"), F.trim(F.replace("_r", F.lit("\\/"), F.lit("/")))), "#.*$", "")
    e = e.select(key, "_i", A.plain_form(full).alias("link")).where(F.col("link").rlike("^https?://[^/]") & is_document(F.col("link")))
    # A page's links are few: they are put together again by its key, in order, each once.
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "link"))).alias("x"))
    once = F.slice(F.array_distinct(F.transform("x", lambda y: y["link"])), F.lit(1), F.lit(most))
    return g.select(key, F.posexplode(once).alias("pos", "link")).withColumn("pos", F.col("pos").cast("long"))


def publisher_candidates(url: Column) -> Column:
    """Addresses of documents that a publisher's address stands for, by PUBLISHERS in order, each once; a number in a query
    stands in for a path without one where the service takes both."""
    # Arrays of one, so that the compared form and its parts are made once for an address and not once for each rule.
    parts = F.transform(F.array(A.plain_form(url)), lambda u: F.struct(F.regexp_extract(u, "^(https?://[^/?#]*)", 1).alias("origin"), A.part(u, A.PATH).alias("path"), A.part(u, A.QUERY).alias("query")))
    parts = F.transform(parts, lambda p: F.struct(F.regexp_extract(p["origin"], "^https?://(?:[^/@]*@)?([^:/]*)", 1).alias("host"), p["origin"].alias("origin"), p["path"].alias("path"), p["query"].alias("query")))
    return F.get(F.transform(parts, lambda p: _by_publishers(p["host"], p["origin"], p["path"], p["query"])), 0)


def _by_publishers(host: Column, origin: Column, path: Column, query: Column) -> Column:
    found = []
    for name, exact, pattern, target, search in PUBLISHERS:
        fits = (host == name if exact else host.endswith(name)) & path.rlike(pattern)
        tail = query if search == "own" else F.lit("") if search is None else F.regexp_replace(path, pattern, search.replace("?", "\\?")) if "$" in search else F.lit(search)
        found.append(F.when(fits, F.concat(origin, F.regexp_replace(path, pattern, target), tail)))
        if name == "ieee.org":
            number = F.regexp_extract(query, "[?&]arnumber=([^&]+)", 1)
            found.append(F.when(host.endswith(name) & ~path.rlike(pattern) & (number != ""), F.concat(origin, F.lit(target + "?tp=&arnumber="), number)))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))

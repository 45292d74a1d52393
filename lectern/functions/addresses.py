"""Addresses by RFC 3986 as column functions: parts, resolution against a base, suffixes of hosts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of an address: scheme, authority with its slashes, path, query with "?", fragment with "#"; "" where absent.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = range(1, 6)


def part(url: Column, which: int) -> Column:
    return F.regexp_extract(url, PARTS, which)


def without_dots(path: Column) -> Column:
    """A path without its "." and ".." segments. Only paths that have some are taken apart."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    whole = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(path)


def resolved(base: Column, ref: Column) -> Column:
    """The address that a reference means on a page of address `base` (RFC 3986, 5.2); null if either is null."""
    scheme, authority, path, query, fragment = (part(ref, i) for i in range(1, 6))
    b_scheme, b_authority, b_path, b_query, _ = (part(base, i) for i in range(1, 6))
    merged = F.when((b_authority != "") & (b_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(b_path, "(?s)^(.*/)", 1), path))
    own, rooted = (scheme != "") | (authority != ""), path.startswith("/")
    new_path = F.when(own | rooted, without_dots(path)).when(path == "", b_path).otherwise(without_dots(merged))
    new_query = F.when(~own & (path == "") & (query == ""), b_query).otherwise(query)
    new_scheme = F.when(scheme != "", scheme).otherwise(b_scheme)
    new_authority = F.when(own, authority).otherwise(b_authority)
    return F.concat(F.when(new_scheme != "", F.concat(new_scheme, F.lit(":"))).otherwise(""), new_authority, new_path, new_query, fragment)


def plain_form(url: Column) -> Column:
    """An address as it is compared: scheme and host in lower case, no default port, "/" for an empty path, no fragment."""
    scheme = F.lower(part(url, SCHEME))
    authority = F.lower(part(url, AUTHORITY))
    default = F.when(scheme == "http", F.regexp_replace(authority, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(authority, ":(443)?$", "")).otherwise(authority)
    path = F.when((part(url, PATH) == "") & (authority != ""), "/").otherwise(part(url, PATH))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), default, path, part(url, QUERY))


def suffixes(host: Column, most: int) -> Column:
    """The last one, two, ... `most` labels of a host, and the host itself where it has fewer; no suffix twice."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, most + 1)]))


def unescaped(value: Column) -> Column:
    """A markup attribute's value with the five common character references read."""
    for pattern, char in (("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&")):
        value = F.regexp_replace(value, pattern, char)
    return value


#: An attribute: its name, and its value as it stands, quotes included. Nothing that was taken is given back.
ATTRIBUTE = r"[^\s=/>\"']++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, without quotes, character references read; null if there is none."""
    found = F.filter(F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]*+", ""), F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*(=|$)"))
    value = F.regexp_replace(F.get(found, 0), r"^[^=]*=?\s*", "")
    return unescaped(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2"))


def tags(html: Column, names: str) -> Column:
    """All tags of some names (alternatives of a pattern), attributes included; none inside comments and scripts."""
    clean = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript)\b.*?(?:</\1|\z)", " ")
    return F.regexp_extract_all(clean, F.lit(rf"(?i)<(?:{names})(?=[\s/>])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>?"), F.lit(0))

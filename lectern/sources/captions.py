"""Caption files, web links and addresses as columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One cue's timing line in WebVTT or SRT (fixed format).
TIMING = r"(?:([0-9]+):)?([0-9]{2}):([0-9]{2})[.,]([0-9]{3})\s+-->\s+(?:([0-9]+):)?([0-9]{2}):([0-9]{2})[.,]([0-9]{3})"


def _seconds(line: Column, first: int) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(line, TIMING, first + i).try_cast("double"), F.lit(0.0))
    return part(0) * 3600 + part(1) * 60 + part(2) + part(3) / 1000


def parse_captions(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue, start, end, text): blocks between blank lines with a timing line, tags stripped, ordered by start.
    Header, NOTE, STYLE and REGION blocks go; cues that end before they start go."""
    block = files.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("cue", "block"))
    block = block.where(~F.col("block").rlike(r"^\s*(WEBVTT|NOTE|STYLE|REGION)") & F.col("block").rlike(TIMING))
    body = F.regexp_replace(F.regexp_replace(F.col("block"), r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(a), F.lit(b))
    out = block.select(key, F.col("cue").cast("long").alias("cue"), _seconds(F.col("block"), 1).alias("start"), _seconds(F.col("block"), 5).alias("end"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))
    return out.where((F.col("text") != "") & (F.col("end") > F.col("start")))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, link): distinct href and src values of a page, at the place of their first occurrence."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?:href|src)=\"([^\"]+)\""), F.lit(1))
    e = pages.select(key, F.posexplode(found).alias("pos", "link"))
    return e.groupBy(key, "link").agg(F.min("pos").cast("long").alias("pos"))


def origin(url: Column) -> Column:
    """scheme://host of an address, lower case, without default ports."""
    o = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1))
    return F.regexp_replace(F.regexp_replace(o, r"^(http://[^/:]+):80$", "$1"), r"^(https://[^/:]+):443$", "$1")

"""Formats and repairs of text records as column functions: JSON envelopes, file names, proportional splits, medians."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose_json(text: Column) -> Column:
    """The JSON object or array inside a reply: fences stripped, cut to the outermost brackets, trailing commas dropped."""
    body = F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    first = F.regexp_instr(body, F.lit(r"[\[{]"))
    cut = F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)
    return F.when(first > 0, F.regexp_replace(cut, r",\s*([\]}])", "$1"))


def safe_name(title: Column, number: Column, most: int = 80) -> Column:
    """0001-title, without reserved characters, of `most` characters at most; an empty title is "untitled"."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    plain = F.regexp_replace(F.substring(plain, 1, most), r"[. ]+$", "")
    reserved = F.lower(plain).rlike(r"^(con|prn|aux|nul|com[0-9]|lpt[0-9])$")
    return F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("-"), F.when(F.coalesce(plain, F.lit("")) == "", "untitled").when(reserved, F.concat(F.lit("_"), plain)).otherwise(plain))


def split_by_weight(text: Column, weights: Column) -> Column:
    """A text cut into as many parts as weights, in proportion to them; the parts joined give the text."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    upto = lambda n: F.when(n <= 0, 0).when(n >= F.size(weights), F.length(text)).otherwise(F.bround(F.length(text) * F.aggregate(F.slice(weights, 1, n), F.lit(0.0), lambda s, x: s + x) / total).cast("int"))
    return F.transform(weights, lambda w, i: F.substr(text, upto(i) + 1, upto(i + 1) - upto(i)))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array; 0 if it is empty."""
    return F.when(F.size(values) == 0, F.lit(0)).otherwise(F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1))


def around(text: Column, part: Column, width: int = 200) -> Column:
    """The first occurrence of a part with `width` characters on both sides; null if there is none."""
    at = F.position(part, text)
    begin = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + F.length(part) + width))


#: Entries and characters of an analysis that are kept.
CHAPTERS, QUOTES, MOMENTS, TITLE, SUMMARY, QUOTE = 100, 50, 100, 300, 1500, 3000


def safe_seconds(value: Column, most: Column) -> Column:
    """Whole seconds of a time within a medium; null for others. A medium of no known length has no bound."""
    bound = F.when(most > 0, most)
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < float("inf")) & F.coalesce(v <= bound, F.lit(True)), F.floor(v))


def minutes(seconds: Column) -> Column:
    """Seconds as m:ss."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def _timed(entries: Column, most: Column, limit: int, fields: dict[str, int], need: str) -> Column:
    one = lambda x, i: F.struct(safe_seconds(x["seconds"], most).alias("seconds"), i.alias("i"), *[F.left(F.trim(F.coalesce(x[f], F.lit(""))), F.lit(n)).alias(f) for f, n in fields.items()])
    fine = F.filter(F.transform(F.slice(F.coalesce(entries, F.array()), F.lit(1), limit), one), lambda x: x["seconds"].isNotNull() & (x[need] != ""))
    return F.transform(F.array_sort(fine), lambda x: F.struct(x["seconds"].alias("seconds"), minutes(x["seconds"]).alias("at"), *[x[f].alias(f) for f in fields]))


def safe_chapters(chapters: Column, most: Column) -> Column:
    """Chapters (struct of seconds, title, summary) of an analysis, in order of time: those without a title or with a time
    outside the medium go, long texts are cut."""
    return _timed(chapters, most, CHAPTERS, {"title": TITLE, "summary": SUMMARY}, "title")


def safe_quotes(quotes: Column, most: Column) -> Column:
    """Quotes (struct of seconds, quote) of an analysis, in the same way."""
    return _timed(quotes, most, QUOTES, {"quote": QUOTE}, "quote")


def safe_moments(moments: Column, most: Column) -> Column:
    """Times of an analysis that lie within the medium, as they come."""
    return F.slice(F.filter(F.transform(F.coalesce(moments, F.array()), lambda x: safe_seconds(x, most)), lambda x: x.isNotNull()), F.lit(1), MOMENTS)

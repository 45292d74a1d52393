"""Caption tracks as JSON events, and the choice among the sources of a recording's captions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string,tOffsetMs:double>>>>>"


def parse_json3(files: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, text, start_ms, duration_ms, last_ms) of a track's events in their order; pos is the place in the file.
    Segments are joined, white space is one space, marks of a change of speaker (>>) go, and so do events without text.
    last_ms is where the last word begins. A text that is no such JSON has no events."""
    e = files.select(key, F.posexplode(F.from_json(json, EVENTS)["events"]).alias("pos", "e"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"\s+", " "))
    text = F.trim(F.regexp_replace(text, r"(^|\s)>{2,}\s*", "$1"))
    said = F.filter("e.segs", lambda s: (F.trim(s["utf8"]) != "") & ~s["utf8"].rlike(r"^\s*$") & s["tOffsetMs"].isNotNull())
    start = F.coalesce("e.tStartMs", F.lit(0.0))
    last = start + F.when(F.size(said) > 0, F.element_at(said, -1)["tOffsetMs"]).otherwise(0.0)
    out = e.where("e.segs is not null").select(key, F.col("pos").cast("long").alias("pos"), text.alias("text"), start.alias("start_ms"), F.coalesce("e.dDurationMs", F.lit(0.0)).alias("duration_ms"), last.alias("last_ms"))
    return out.where("text <> ''")


def language_rank(language: Column, preferred: Column) -> Column:
    """2 for the preferred language, 1 for another form of it, else 0."""
    base = lambda x: F.split_part(x, F.lit("-"), F.lit(1))
    return F.when(language == preferred, 2).when(base(language) == base(preferred), 1).otherwise(0)


#: Kinds of sources in the order in which they are taken (fixed values).
SOURCES = ("previous", "archive", "track", "loaded", "media")


def chosen_source(candidates: DataFrame, key: str, preferred: Column) -> DataFrame:
    """One row per recording from candidates (key, kind, language, ord, usable): the first kind in SOURCES that has a usable
    row, there the best language, there the first; recordings without one have a null kind."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SOURCES]), F.col("kind")), F.lit(99))
    w = Window.partitionBy(key).orderBy(F.desc("usable"), place, F.desc(F.when(F.col("kind") == "track", language_rank(F.col("language"), preferred)).otherwise(0)), "ord")
    best = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select(key, F.when(F.col("usable"), F.col("kind")).alias("kind"), F.when(F.col("usable"), F.col("language")).alias("language"), F.when(F.col("usable"), F.col("ord")).alias("ord"))

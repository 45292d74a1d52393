"""Stores of sessions and archives as tables: lookups with tolerance, progress, exports, notes, caches, saved jobs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import srt_time
from lectern.functions.web import stamp


def blank(text: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))) == ""


def lookup_archive(asked: DataFrame, archives: DataFrame, keys: list[str], duration: str = "duration", within: float = 2.0, best: str = "translated", order: str = "archive_id") -> DataFrame:
    """asked rows with the archive of equal keys whose duration differs by `within` at most: the most translated one, then
    the first; null fields where there is none. Rows of asked must be distinct by `ask_id`."""
    a = archives.withColumnRenamed(duration, "_d")
    hit = asked.join(a, keys).where(F.abs(F.col(duration) - F.col("_d")) <= within)
    w = Window.partitionBy("ask_id").orderBy(F.desc(best), order)
    first = hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("ask_id", order, best)
    return asked.join(first, "ask_id", "left")


def locate_session(asked: DataFrame, sessions: DataFrame, similar: DataFrame) -> DataFrame:
    """(ask_id, session_id, kind) for asked (ask_id, document, profile) among sessions (session_id, document, profile,
    updated): the exact document and profile, else the most similar document's of the profile (ties: latest), else kind says
    why there is none: other-profile if only other profiles have the document or one like it, or none. similar has
    (document, other, score) of compatible documents, in both directions."""
    exact = asked.join(sessions, ["document", "profile"]).select("ask_id", "session_id", F.lit(0).alias("tier"), F.lit(1.0).alias("score"), "updated")
    near = asked.join(similar, "document").join(sessions.withColumnRenamed("document", "other").withColumnRenamed("profile", "_p"), "other")
    like = near.where("_p = profile").select("ask_id", "session_id", F.lit(1).alias("tier"), "score", "updated")
    same = asked.join(sessions.withColumnRenamed("profile", "_p"), "document").select("ask_id", "_p", "profile").union(near.select("ask_id", "_p", "profile"))
    missed = same.where("_p <> profile").select("ask_id", F.lit(None).cast(sessions.schema["session_id"].dataType).alias("session_id"), F.lit(2).alias("tier"), F.lit(0.0).alias("score"), F.lit(None).cast(sessions.schema["updated"].dataType).alias("updated")).distinct()
    w = Window.partitionBy("ask_id").orderBy("tier", F.desc("score"), F.desc("updated"), "session_id")
    best = exact.union(like).union(missed).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kind = F.when(F.col("tier") == 0, "exact").when(F.col("tier") == 1, "compatible").when(F.col("tier") == 2, "other-profile").otherwise("none")
    return asked.select("ask_id").join(best, "ask_id", "left").select("ask_id", "session_id", kind.alias("kind"))


def progress(rows: DataFrame, key: str, order: str, translation: str, end: str) -> DataFrame:
    """(key, done, total, percent, ready, complete): translated rows, the largest end within the translated beginning."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_done", ~blank(translation)).withColumn("_open", F.min("_done").over(w))
    done, total = F.count_if("_done"), F.count("*")
    return r.groupBy(key).agg(done.alias("done"), total.alias("total"), F.floor(100 * done / total).alias("percent"), F.coalesce(F.max(F.when(F.col("_open"), F.col(end))), F.lit(0)).alias("ready"), (done == total).alias("complete"))


def _document(rows: DataFrame, key: str, order: str, line: Column, seam: str, head: Column | None = None) -> DataFrame:
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("r"), F.count("*").alias("total"), F.count_if(~blank("translation")).alias("done"))
    text = F.array_join(F.transform("r", lambda x: x["x"]), seam)
    return g.select(key, F.concat(head, text).alias("doc") if head is not None else text.alias("doc"), (F.col("done") == F.col("total")).alias("complete"))


#: What stands for a translation that is not there yet (fixed value).
MISSING = "（尚未翻译）"


def markdown(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, doc, complete): a bilingual document per key with its progress, numbered rows and their time ranges. rows have
    start, end, source and translation; a key's rows (one recording) become one text."""
    n = F.lpad(F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string"), 4, "0")
    line = F.concat(F.lit("## "), F.col("_n"), F.lit(" "), stamp(F.col("start")), F.lit(" – "), stamp(F.col("end")), F.lit("\n\n"), F.col("source"), F.lit("\n\n"), F.when(blank("translation"), MISSING).otherwise(F.col("translation")))
    head = F.concat(F.lit("Translated: "), F.col("done").cast("string"), F.lit(" / "), F.col("total").cast("string"), F.lit("\n\n"))
    return _document(rows.withColumn("_n", n), key, order, line, "\n\n", head)


def srt(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, doc, complete): a subtitle file per key. A row without an end ends just before the next begins, 0.8 s after its
    start at least, or 4 s after it as the last."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = F.lead("start").over(w)
    end = F.coalesce(F.col("end"), F.when(nxt.isNull(), F.col("start") + 4).otherwise(F.greatest(F.col("start") + 0.8, nxt - 0.05)))
    r = rows.withColumn("_n", F.row_number().over(w)).withColumn("_e", end)
    line = F.concat(F.col("_n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("_e")), F.lit("\n"), F.when(blank("translation"), F.col("source")).otherwise(F.concat("source", F.lit("\n"), "translation")))
    return _document(r, key, order, line, "\n\n")


def print_view(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, doc, complete): numbered pairs of source and translation as HTML."""
    from lectern.functions.split import escaped

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string")
    line = F.concat(F.lit("<section><h2>"), F.col("_n"), F.lit("</h2><p>"), escaped(F.col("source")), F.lit("</p><p>"), escaped(F.when(blank("translation"), MISSING).otherwise(F.col("translation"))), F.lit("</p></section>"))
    return _document(rows.withColumn("_n", n), key, order, line, "\n")


def finished_only(documents: DataFrame) -> DataFrame:
    """Documents that are complete; asking for another is an error with its key, not a shorter export."""
    key = documents.columns[0]
    return documents.select(key, F.when(F.col("complete"), F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("not all rows are translated: "), F.col(key).cast("string")))).alias("doc"))


def with_note(notes: DataFrame, new: DataFrame, time: str = "saved") -> DataFrame:
    """notes with the new ones; a note of equal id is replaced. Readers order by time, latest first."""
    return notes.join(new.select("note_id"), "note_id", "left_anti").unionByName(new, allowMissingColumns=True)


def notes_of(notes: DataFrame, video: Column, page: Column) -> DataFrame:
    """The notes of a video or of a page, whichever is given."""
    return notes.where(F.when(video.isNotNull(), F.col("video") == video).otherwise(F.col("page") == page))


def cache_key(parts: list[Column]) -> Column:
    """A digest of parts in order; null parts count as empty and do not run into their neighbours."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def fresh_entries(cache: DataFrame, now: Column, days: int = 30, saved: str = "saved") -> DataFrame:
    return cache.where(F.col(saved) >= now - F.make_dt_interval(F.lit(days)))


def restored(current: DataFrame, saved: DataFrame, keys: list[str], valid) -> DataFrame:
    """current rows with the saved translations that are still valid by the given test (source, translation) and the flags
    restored and invalidated."""
    s = saved.select(*keys, F.col("translation").alias("_t"))
    r = current.join(s, keys, "left")
    ok = valid(F.col("source"), F.col("_t"))
    said = ~blank("_t")
    return r.withColumn("restored", said & ok).withColumn("invalidated", said & ~ok).withColumn("translation", F.when(F.col("restored"), F.col("_t"))).drop("_t")


def conditional_swap(current: Column, ours: Column, other: Column) -> Column:
    """The other text if the current one is still ours, else the current one."""
    return F.when(current.eqNullSafe(ours), other).otherwise(current)


def saved_state(rows: DataFrame, key: str) -> DataFrame:
    """(key, state) of restored archives: complete if all rows are translated, else paused."""
    return rows.groupBy(key).agg(F.when(F.min(~blank("translation")), "complete").otherwise("paused").alias("state"))


def queue_batches(rows: DataFrame, cached: DataFrame, keys: list[str], group: str, order: str, size: int = 3) -> DataFrame:
    """Rows that the cache has not, in batches of `size` in order, per group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.join(cached.select(*keys).distinct(), keys, "left_anti").withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def pages_for_ocr(blocks: DataFrame, page: list[str], text: str, least: int = 20) -> DataFrame:
    """Pages with fewer than `least` characters of text."""
    return blocks.groupBy(*page).agg(F.coalesce(F.sum(F.length(F.trim(text))), F.lit(0)).alias("chars")).where(F.col("chars") < least)


def outline(blocks: DataFrame, key: str, order: str, role: str = "role", text: str = "text", page: str = "page") -> DataFrame:
    """(key, place, title): headings in reading order, the first of each text, up to 180 characters; a document without any
    has a row per page."""
    h = blocks.where((F.col(role) == "heading") & ~blank(text))
    first = h.groupBy(key, text).agg(F.min(order).alias("place")).select(key, "place", F.substring(text, 1, 180).alias("title"))
    bare = blocks.select(key, F.col(page).cast("long").alias("place")).distinct().join(h.select(key).distinct(), key, "left_anti")
    return first.unionByName(bare.withColumn("title", F.concat(F.lit("Page "), (F.col("place") + 1).cast("string"))))


def largest_player(players: DataFrame, key: str) -> DataFrame:
    """The player of each page: one that plays before others, then the largest, then the first."""
    w = Window.partitionBy(key).orderBy(F.desc("playing"), F.desc("area"), "ord")
    return players.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cached_matches(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(doc, page, block, saved_page, saved_block, tier, translation): saved translations for the blocks (doc, page, block, text
    in its normal form) of documents. First those of the same place and text, then, in order, those of the same text on the
    same page, then those of the same text anywhere in the document. A saved block serves once; blank texts and saved
    blocks (doc, page, block, text, translation) without a translation match nothing."""
    # Within a document texts are compared by 128 bits of a hash: one shuffle by document and text serves all tiers, and no text is shuffled.
    same = F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("_h")
    kind = {c: saved.schema[c].dataType for c in ("page", "block", "translation")}
    at = ["doc", "page", "block", same]
    cur = current.where("text <> ''").select(*at, F.lit(False).alias("_old"), F.lit(None).cast(kind["translation"]).alias("translation"))
    old = saved.where((F.col("text") != "") & (F.coalesce("translation", F.lit("")) != "")).select(*at, F.lit(True).alias("_old"), "translation")
    x = cur.unionByName(old).repartition("doc", "_h").withColumn("_met", F.lit(None).cast("struct<tier:int," + ",".join(f"{c}:{k.simpleString()}" for c, k in kind.items()) + ">"))
    for tier, by in ((1, ["doc", "_h", "page", "block"]), (2, ["doc", "_h", "page"]), (3, ["doc", "_h"])):
        # The nth block of a text that is still open takes the nth one that is still free.
        w = Window.partitionBy(*by, "_old", F.isnull("_met")).orderBy("page", "block")
        x = x.withColumn("_n", F.when(F.isnull("_met"), F.row_number().over(w)))
        pair = Window.partitionBy(*by, "_n")
        theirs = F.max(F.when(F.col("_old"), F.struct(F.lit(tier).alias("tier"), *[F.col(c).cast(k).alias(c) for c, k in kind.items()]))).over(pair)
        mine = F.max(~F.col("_old")).over(pair)
        hit = F.col("_n").isNotNull() & F.col("_t").isNotNull() & F.col("_m")
        x = x.withColumn("_t", theirs).withColumn("_m", mine).withColumn("_met", F.when(hit, F.col("_t")).otherwise(F.col("_met"))).drop("_n", "_t", "_m")
    return x.where(~F.col("_old") & F.col("_met").isNotNull()).select("doc", "page", "block", F.col("_met.page").alias("saved_page"), F.col("_met.block").alias("saved_block"), "_met.tier", "_met.translation")

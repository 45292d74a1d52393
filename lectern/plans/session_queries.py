"""Queries on sessions, archives, exports, notes, caches and jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import formats as M
from lectern.operators import sessions as S
from lectern.plans.registry import query, t
from lectern.plans.text_queries import _LINES, lines
from lectern.sources import timedtext

_CUES = "cues as (select conv_id, turn, (30 * turn)::double as start, (30 * turn + 2.5)::double as e, text as source, case when conv_id % 4 = 1 and turn % 3 = 2 then ' ' else 'T ' || substr(text, 1, 30) end as translation from conversations)"


def cues(spark, d):
    said = F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") % 3 == 2), " ").otherwise(F.concat(F.lit("T "), F.substring("text", 1, 30)))
    return t(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 2.5).alias("end"), F.col("text").alias("source"), said.alias("translation"))


@query("with " + _CUES + ", o as (select *, min(case when trim(translation) <> '' then 1 else 0 end) over (partition by conv_id order by turn) open from cues) select conv_id, cast(count(*) filter (trim(translation) <> '') as bigint) done, cast(count(*) as bigint) total, cast(floor(100.0 * count(*) filter (trim(translation) <> '') / count(*)) as bigint) percent, coalesce(max(e) filter (open = 1), 0)::double ready, bool_and(trim(translation) <> '') complete from o group by 1")
def translation_progress(spark, d):
    return S.progress(cues(spark, d), "conv_id", "turn", "translation", "end")


_STAMP = "lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} % 3600000 // 60000 as varchar), 2, '0') || ':' || lpad(cast({0} % 60000 // 1000 as varchar), 2, '0') || '{1}' || lpad(cast({0} % 1000 as varchar), 3, '0')"
_MS = "cast({} * 1000 as bigint)"


@query("with " + _CUES + ", n as (select *, row_number() over (partition by conv_id order by turn) n from cues) select conv_id, md5('Translated: ' || count(*) filter (trim(translation) <> '') || ' / ' || count(*) || chr(10) || chr(10) || string_agg('## ' || lpad(cast(n as varchar), 4, '0') || ' ' || " + _STAMP.format(_MS.format("start"), ".") + " || ' – ' || " + _STAMP.format(_MS.format("e"), ".") + " || chr(10) || chr(10) || source || chr(10) || chr(10) || case when trim(translation) = '' then '（尚未翻译）' else translation end, chr(10) || chr(10) order by turn)) as doc, bool_and(trim(translation) <> '') complete from n group by 1")
def markdown_export(spark, d):
    return S.markdown(cues(spark, d), "conv_id", "turn").select("conv_id", F.md5("doc").alias("doc"), "complete")


@query("with " + _CUES + ", n as (select *, row_number() over (partition by conv_id order by turn) n, case when turn % 2 = 0 then e when lead(start) over w is null then start + 4 else greatest(start + 0.8, lead(start) over w - 0.05) end f from cues window w as (partition by conv_id order by turn)) select conv_id, md5(string_agg(n || chr(10) || " + _STAMP.format(_MS.format("start"), ",") + " || ' --> ' || " + _STAMP.format("cast(round(f * 1000) as bigint)", ",") + " || chr(10) || source || case when trim(translation) = '' then '' else chr(10) || translation end, chr(10) || chr(10) order by turn)) as doc, bool_and(trim(translation) <> '') complete from n group by 1")
def srt_export(spark, d):
    c = cues(spark, d).withColumn("end", F.when(F.col("turn") % 2 == 0, F.col("end")))
    return S.srt(c, "conv_id", "turn").select("conv_id", F.md5("doc").alias("doc"), "complete")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("with " + _CUES + ", f as (select conv_id from cues group by 1 having bool_and(trim(translation) <> '')), n as (select *, row_number() over (partition by conv_id order by turn) n from cues join f using (conv_id)) select conv_id, md5(string_agg('<section><h2>' || n || '</h2><p>' || " + _ESC.format("source") + " || '</p><p>' || " + _ESC.format("translation") + " || '</p></section>', chr(10) order by turn)) as doc from n group by 1")
def print_export_of_finished(spark, d):
    return S.finished_only(S.print_view(cues(spark, d), "conv_id", "turn").where("complete")).select("conv_id", F.md5("doc").alias("doc"))


@query("with a as (select o_custkey, o_orderkey as archive_id, o_totalprice d, o_orderkey % 17 as translated from orders where o_orderkey % 3 = 0), q as (select o_custkey, o_orderkey ask_id, o_totalprice d from orders where o_orderkey % 3 = 1), h as (select ask_id, archive_id, row_number() over (partition by ask_id order by translated desc, archive_id) n from q join a using (o_custkey) where abs(q.d - a.d) <= 20000) select q.ask_id, h.archive_id from q left join h on q.ask_id = h.ask_id and n = 1")
def archive_lookup(spark, d):
    o = t(spark, d, "orders")
    a = o.where("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("archive_id"), F.col("o_totalprice").alias("duration"), (F.col("o_orderkey") % 17).alias("translated"))
    q = o.where("o_orderkey % 3 = 1").select("o_custkey", F.col("o_orderkey").alias("ask_id"), F.col("o_totalprice").alias("duration"))
    return S.lookup_archive(q, a, ["o_custkey"], within=20_000.0).select("ask_id", "archive_id")


_LOCATE = "s as (select event_id session_id, user_id as document, event_type as profile, ts updated from events where event_id % 4 = 0), q as (select event_id ask_id, user_id as document, event_type as profile from events where event_id % 4 = 1), sim as (select distinct user_id as document, user_id + 1 as other, 0.8 + (user_id % 10) / 100.0 as score from events union select distinct user_id + 1, user_id, 0.75 from events)"


@query(
    "with " + _LOCATE + ", near as (select ask_id, session_id, score, updated, q.profile, s.profile p from q join sim using (document) join s on s.document = other), c as (select ask_id, session_id, 0 tier, 1.0::double score, updated from q join s using (document, profile) union all select ask_id, session_id, 1, score, updated from near where p = profile union all "
    "select distinct ask_id, null, 2, 0.0, null::timestamp from (select ask_id from q join s using (document) where s.profile <> q.profile union all select ask_id from near where p <> profile)), b as (select *, row_number() over (partition by ask_id order by tier, score desc, updated desc, session_id) n from c) "
    "select q.ask_id, session_id, case tier when 0 then 'exact' when 1 then 'compatible' when 2 then 'other-profile' else 'none' end kind from q left join b on b.ask_id = q.ask_id and n = 1"
)
def session_lookup(spark, d):
    e = t(spark, d, "events")
    s = e.where("event_id % 4 = 0").select(F.col("event_id").alias("session_id"), F.col("user_id").alias("document"), F.col("event_type").alias("profile"), F.col("ts").alias("updated"))
    q = e.where("event_id % 4 = 1").select(F.col("event_id").alias("ask_id"), F.col("user_id").alias("document"), F.col("event_type").alias("profile"))
    u = e.select("user_id").distinct()
    sim = u.select(F.col("user_id").alias("document"), (F.col("user_id") + 1).alias("other"), (0.8 + (F.col("user_id") % 10) / 100.0).alias("score")).union(u.select(F.col("user_id") + 1, F.col("user_id"), F.lit(0.75)))
    return S.locate_session(q, s, sim)


@query("with " + _LINES + ", saved as (select doc_id, line, case when line % 3 = 0 then '' else 'T' || l end tr from lines where line % 5 <> 2) select c.doc_id, cast(count(*) filter (tr <> '' and c.line % 4 <> 1) as bigint) restored, cast(count(*) filter (tr <> '' and c.line % 4 = 1) as bigint) invalidated, cast(count(*) as bigint) n from lines c left join saved s on s.doc_id = c.doc_id and s.line = c.line group by 1")
def session_restore(spark, d):
    cur = lines(spark, d).select("doc_id", "line", F.col("l").alias("source"))
    saved = lines(spark, d).where("line % 5 <> 2").select("doc_id", "line", F.when(F.col("line") % 3 == 0, "").otherwise(F.concat(F.lit("T"), "l")).alias("translation"))
    r = S.restored(cur, saved, ["doc_id", "line"], lambda s, x: F.col("line") % 4 != 1)
    return r.groupBy("doc_id").agg(F.count_if(F.coalesce("restored", F.lit(False))).alias("restored"), F.count_if(F.coalesce("invalidated", F.lit(False))).alias("invalidated"), F.count("*").alias("n"))


@query("with k as (select event_id, user_id, ts, sha256('[\"' || user_id || '\",\"' || event_type || '\"]') as key from events where ts >= (select max(ts) from events) - interval 10 day) select key, cast(count(*) as bigint) n from k group by 1")
def cache_entries_by_key(spark, d):
    e = t(spark, d, "events")
    now = e.agg(F.max("ts").alias("_now"))  # one row
    f = S.fresh_entries(e.crossJoin(F.broadcast(now)), F.col("_now"), 10, "ts")
    return f.groupBy(S.cache_key([F.col("user_id"), F.col("event_type")]).alias("key")).agg(F.count("*").alias("n"))


@query("with p as (select *, row_number() over (partition by conv_id order by turn) r from conversations where not (turn % 4 = 2)) select conv_id, turn, (r - 1) // 3 as batch from p")
def queued_batches(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn")
    return S.queue_batches(c, c.where("turn % 4 = 2"), ["conv_id", "turn"], "conv_id", "turn")


@query("with c as (select conv_id as page, turn, 'note ' || turn as text, conv_id * 100 + turn as note_id from conversations), kept as (select * from c where turn % 3 = 0 and turn % 6 <> 0), new as (select page, turn, text || '!' as text, note_id from c where turn % 6 = 0 or turn % 3 = 1) select note_id, page, text from kept union all select note_id, page, text from new")
def note_upserts(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("page"), "turn", F.concat(F.lit("note "), F.col("turn").cast("string")).alias("text"), (F.col("conv_id") * 100 + F.col("turn")).alias("note_id"))
    new = c.where("turn % 6 = 0 or turn % 3 = 1").withColumn("text", F.concat("text", F.lit("!")))
    return S.with_note(c.where("turn % 3 = 0"), new).select("note_id", "page", "text")


@query("select event_id, case when event_id % 2 = 0 then 'original' else event_type end as shown from events")
def shown_text_swap(spark, d):
    e = t(spark, d, "events")
    ours = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return e.select("event_id", S.conditional_swap(F.col("event_type"), ours, F.lit("original")).alias("shown"))


@query("with b as (select doc_id, line, l, line // 40 as page, case when length(l) between 1 and 40 and line % 3 = 0 and doc_id % 2 = 0 then 'heading' else 'body' end role from (with " + _LINES + " select * from lines)), h as (select doc_id, min(line) place, l from b where role = 'heading' and trim(l) <> '' group by doc_id, l) select doc_id, place, substr(l, 1, 180) title from h union all select distinct doc_id, page, 'Page ' || (page + 1) from b where doc_id not in (select doc_id from h)")
def outline_headings(spark, d):
    heading = F.length("l").between(1, 40) & (F.col("line") % 3 == 0) & (F.col("doc_id") % 2 == 0)
    b = lines(spark, d).select("doc_id", "line", F.col("l").alias("text"), F.floor(F.col("line") / 40).alias("page"), F.when(heading, "heading").otherwise("body").alias("role"))
    return S.outline(b, "doc_id", "line")


@query("select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_size % 2 desc, p_size desc, p_partkey) n from part) where n = 1")
def largest_playing_first(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 2).alias("playing"), F.col("p_size").alias("area"), F.col("p_partkey").alias("ord"))
    return S.largest_player(p, "p_brand").select("p_brand", "p_partkey")


@query("with c as (select p_brand k, (['media', 'track', 'loaded', 'archive', 'previous'])[1 + p_partkey % 5] kind, (['de', 'en-US', 'en', 'fr'])[1 + p_partkey % 4] lang, p_partkey as ord, p_size > 25 as usable from part), r as (select *, row_number() over (partition by k order by usable desc, case kind when 'previous' then 1 when 'archive' then 2 when 'track' then 3 when 'loaded' then 4 else 5 end, case when kind <> 'track' then 0 when lang = 'en' then 2 when split_part(lang, '-', 1) = 'en' then 1 else 0 end desc, ord) n from c) select k as p_brand, case when usable then kind end kind, case when usable then lang end as language, case when usable then ord end as ord from r where n = 1")
def caption_source_choice(spark, d):
    i = F.col("p_partkey")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (i % n).cast("int"))
    c = t(spark, d, "part").select("p_brand", pick(("media", "track", "loaded", "archive", "previous"), 5).alias("kind"), pick(("de", "en-US", "en", "fr"), 4).alias("language"), i.alias("ord"), (F.col("p_size") > 25).alias("usable"))
    return timedtext.chosen_source(c, "p_brand", F.lit("en"))


_PLACES = "case when line % 8 = 5 then line + 1000000 when line % 4 = 2 then line + 1 when line % 4 = 3 then line - 1 else line end"


@query(
    f"with {_LINES}, cur as (select doc_id doc, line // 10 page, line % 10 block, l as text from lines where l <> ''), old as (select doc_id doc, p // 10 page, p % 10 block, l as text from (select *, {_PLACES} p from lines where l <> '' and line % 7 <> 3)), "
    "t1 as (select doc, page, block, page sp, block sb from cur join old using (doc, page, block, text)), "
    "c2 as (select *, row_number() over (partition by doc, page, text order by block) n from cur anti join t1 using (doc, page, block)), o2 as (select *, row_number() over (partition by doc, page, text order by block) n from old anti join (select doc, sp page, sb block from t1) using (doc, page, block)), "
    "t2 as (select c2.doc, c2.page, c2.block, o2.page sp, o2.block sb from c2 join o2 on c2.doc = o2.doc and c2.page = o2.page and c2.text = o2.text and c2.n = o2.n), b as (select * from t1 union all select * from t2), "
    "c3 as (select *, row_number() over (partition by doc, text order by page, block) n from cur anti join b using (doc, page, block)), o3 as (select *, row_number() over (partition by doc, text order by page, block) n from old anti join (select doc, sp page, sb block from b) using (doc, page, block)) "
    "select doc, page, block, sp saved_page, sb saved_block, 1 tier from t1 union all select doc, page, block, sp, sb, 2 from t2 union all select c3.doc, c3.page, c3.block, o3.page, o3.block, 3 from c3 join o3 on c3.doc = o3.doc and c3.text = o3.text and c3.n = o3.n"
)
def cached_block_matches(spark, d):
    """Lines as blocks of pages of ten; of those saved some are gone, some swapped with a neighbour, some far away."""
    n = F.col("line")
    place = F.when(n % 8 == 5, n + 1_000_000).when(n % 4 == 2, n + 1).when(n % 4 == 3, n - 1).otherwise(n)
    at = lambda c: [F.col("doc_id").alias("doc"), F.floor(c / 10).alias("page"), (c % 10).alias("block"), F.col("l").alias("text")]
    x = lines(spark, d).where("l <> ''")
    return S.cached_matches(x.select(*at(n)), x.where("line % 7 <> 3").select(*at(place), F.lit("T").alias("translation"))).drop("translation")


@query(
    "with c as (select conv_id, turn, 37 * turn - 20 s, trim(text) x from conversations), k as (select *, row_number() over (partition by conv_id order by turn) r from c), f as (select * from k where r <= 100 and s between 0 and 120 and x <> '') "
    "select conv_id, cast(row_number() over (partition by conv_id order by s, r) - 1 as bigint) pos, cast(s as bigint) as \"seconds\", s // 60 || ':' || lpad(cast(s % 60 as varchar), 2, '0') as \"at\", md5(x[1:300]) title, md5(x[1:1500]) summary from f"
)
def safe_chapters(spark, d):
    """Turns as chapters of an analysis; some lie before or behind their medium of two minutes."""
    one = F.struct("turn", (37 * F.col("turn") - 20).cast("string").alias("seconds"), F.col("text").alias("title"), F.col("text").alias("summary"))
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    safe = M.safe_chapters(F.col("c"), F.lit(120.0))
    return c.select("conv_id", F.posexplode(safe).alias("pos", "x")).select("conv_id", F.col("pos").cast("long").alias("pos"), "x.seconds", "x.at", F.md5("x.title").alias("title"), F.md5("x.summary").alias("summary"))

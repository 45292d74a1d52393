"""Queries on keyed and ordered records: joins, windows, folds, merges, exports."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import runs as R
from lectern.operators import sequences as O
from lectern.operators.bags import similar_bags
from lectern.operators.numbering import number_rows
from lectern.plans.registry import query, t
from lectern.plans.text_queries import _LINES, lines
from lectern.sources import captions

@query("select conv_id, turn, md5(coalesce(right(string_agg(text, ' ') over (partition by conv_id order by turn rows between 4 preceding and 1 preceding), 1600), '')) context from conversations")
def context_window_prev4(spark, d):
    return O.context_before(t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("context").alias("context"))


_SRT = "lpad(cast(ms // 3600000 as varchar), 2, '0') || ':' || lpad(cast(ms % 3600000 // 60000 as varchar), 2, '0') || ':' || lpad(cast(ms % 60000 // 1000 as varchar), 2, '0') || ',' || lpad(cast(ms % 1000 as varchar), 3, '0')"


@query(f"select event_id, {_SRT} as end_time from (select event_id, cast(floor((case when nxt is null then s + 4 else greatest(s + 0.8, nxt - 0.05) end) * 1000 + 0.5) as bigint) ms from (select event_id, s, lead(s) over (partition by user_id order by s, event_id) nxt from (select event_id, user_id, epoch(ts) - epoch(timestamp '2024-01-01') s from events)))")
def lead_end_time_srt(spark, d):
    s = F.col("ts").cast("timestamp").cast("double") - F.lit("2024-01-01").cast("timestamp").cast("double")
    e = t(spark, d, "events").withColumn("s", s)
    nxt = F.lead("s").over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    return e.select("event_id", X.srt_time(F.when(nxt.isNull(), F.col("s") + 4).otherwise(F.greatest(F.col("s") + 0.8, nxt - 0.05))).alias("end_time"))


@query("select conv_id, cast(coalesce(max(turn) filter (ok), 0) as bigint) ready from (select conv_id, turn, min(case when length(text) < 600 then 1 else 0 end) over (partition by conv_id order by turn) = 1 ok from conversations) group by conv_id")
def prefix_ready(spark, d):
    return O.ready_prefix(t(spark, d, "conversations"), "conv_id", "turn", F.length("text") < 600, "turn")


@query("select event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) b from events) where b is null or b <> event_type")
def adjacent_dup_suppression(spark, d):
    return O.adjacent_distinct(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "event_type")


@query("select user_id, session, cast(count(*) as bigint) n, cast(min(event_id) as bigint) first_event from (select user_id, event_id, cast(sum(case when gap >= 3600 then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) session from (select *, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) gap from events)) group by all")
def gap_sessionization(spark, d):
    return O.gap_sessions(t(spark, d, "events"), "user_id", "ts", "event_id", 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "with recursive c as (select conv_id, turn, length(text) s, row_number() over (partition by conv_id order by turn) r from conversations), f as (select conv_id, turn, r, s, cast(0 as bigint) batch, 1 n, s tot from c where r = 1 union all "
    "select c.conv_id, c.turn, c.r, c.s, case when n >= 24 or tot + c.s > 4000 then batch + 1 else batch end, case when n >= 24 or tot + c.s > 4000 then 1 else n + 1 end, case when n >= 24 or tot + c.s > 4000 then c.s else tot + c.s end from f join c on f.conv_id = c.conv_id and c.r = f.r + 1) select conv_id, turn, batch from f"
)
def greedy_batches(spark, d):
    return O.greedy_batches(t(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 24, 4000)


@query(
    "with recursive s as (select conv_id, turn, length(coalesce(text, '')) chars, 20.0 * turn + turn % 3 as a, 20.0 * turn + 19.0 + turn % 2 as z, regexp_matches(coalesce(text, ''), '[.!?。！？][\"''”’)]?$') ends, row_number() over (partition by conv_id order by turn) r from conversations), "
    "f as (select conv_id, turn, r, cast(0 as bigint) batch, 1 n, chars tot, a as first, z as last, chars >= 500 and ends as closed from s where r = 1 union all "
    "select x.conv_id, x.turn, x.r, case when x.new then x.batch + 1 else x.batch end, case when x.new then 1 else x.n + 1 end, case when x.new then x.chars else x.tot + x.chars end, case when x.new then x.a else x.first end, x.z, case when x.new then x.chars else x.tot + x.chars end >= 500 and x.ends from "
    "(select s.*, f.batch, f.n, f.tot, f.first, f.closed or f.n >= 24 or f.tot + s.chars > 4000 or s.a - f.last >= 2 or s.z - f.first > 45 as new from f join s on f.conv_id = s.conv_id and s.r = f.r + 1) x) select conv_id, turn, batch from f"
)
def cue_batches(spark, d):
    """Turns as segments of 20 seconds with pauses of up to two: what goes to a model together."""
    c = t(spark, d, "conversations").withColumns({"start": 20.0 * F.col("turn") + F.col("turn") % 3, "end": 20.0 * F.col("turn") + 19.0 + F.col("turn") % 2})
    return R.cue_batches(c, "conv_id", "turn", "text")


@query("select user_id, bool_and(value >= b or b is null) monotone, cast(count(*) as bigint) n from (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) b from events) group by user_id")
def sequence_monotone_check(spark, d):
    b = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t(spark, d, "events").select("user_id", F.coalesce(F.col("value") >= b, F.lit(True)).alias("ok"))
    return e.groupBy("user_id").agg(F.bool_and("ok").alias("monotone"), F.count("*").alias("n"))


@query("with p as (select e.user_id, e.event_id, e.ts, l.event_id found from (select * from events where event_type = 'error') e asof left join (select user_id, ts, max(event_id) event_id from events where event_type = 'view' group by all) l on e.user_id = l.user_id and e.ts >= l.ts) select user_id, event_id, found from p")
def note_asof_context(spark, d):
    e = t(spark, d, "events")
    return O.asof_backward(e.where("event_type = 'error'"), e.where("event_type = 'view'").withColumn("line", F.col("event_id")), "user_id", "ts", "line", "event_id").select("user_id", "event_id", "found")


_CUES = "cues as (select conv_id, turn, 30.0 * turn as s, 30.0 * turn + greatest(1.0, length(text) / 15.0) as e from conversations)"


@query("with " + _CUES + ", clock as (select event_id, user_id % 100 as conv_id, cast(event_id % 300 as double) p from events) select event_id, conv_id, turn from clock join cues using (conv_id) where s <= p and p < e")
def cue_interval_lookup(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", (30.0 * F.col("turn")).alias("s")).join(t(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n")), ["conv_id", "turn"])
    c = c.select(F.col("conv_id").alias("cue_conv"), "turn", "s", (F.col("s") + F.greatest(F.lit(1.0), F.col("n") / 15.0)).alias("e"))
    clock = t(spark, d, "events").select("event_id", (F.col("user_id") % 100).alias("conv_id"), (F.col("event_id") % 300).cast("double").alias("at"))
    b = c.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / 30), F.floor(F.col("e") / 30))))
    hit = clock.withColumn("_b", F.floor(F.col("at") / 30)).join(b, "_b").where("conv_id = cue_conv and s <= at and at < e")
    return hit.select("event_id", "conv_id", "turn")


@query("select conv_id, turn, case when n.text is null or n.text = '' then coalesce(o.text, '') else n.text end as text from (select conv_id, turn, text from conversations where turn % 3 <> 2) o full join (select conv_id, turn, case when turn % 2 = 0 then '' else 'n:' || text end as text from conversations where turn % 5 <> 4) n using (conv_id, turn)")
def archive_merge(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "text")
    new = c.where("turn % 5 <> 4").withColumn("text", F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("n:"), F.col("text"))))
    return O.merge_snapshots(c.where("turn % 3 <> 2"), new, ["conv_id", "turn"], "text")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1")
def latest_wins_union(spark, d):
    e = t(spark, d, "events")
    both = e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1"))
    return O.latest(both, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events where ts >= (select max(ts) from events) - interval 30 day) where r <= 20")
def evict_topn(spark, d):
    e = t(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    kept = e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("interval 30 days"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return kept.withColumn("r", F.row_number().over(w)).where("r <= 20").select("user_id", "event_id")


@query("with reply as (select conv_id, turn, upper(text) x from conversations where not (conv_id % 7 = 0 and turn = 1)) select c.conv_id, cast(count(*) as bigint) n, bool_and(x is not null) accepted from conversations c left join reply r using (conv_id, turn) group by c.conv_id")
def strict_id_alignment(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "text")
    reply = c.where("not (conv_id % 7 = 0 and turn = 1)").select("conv_id", "turn", F.upper("text").alias("x"))
    return c.join(reply, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(F.col("x").isNotNull()).alias("accepted"))


@query("with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i from conversations where role = 'user'), a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) i from conversations where role = 'assistant'), n as (select conv_id from (select conv_id, count(*) filter (role = 'user') nu, count(*) filter (role = 'assistant') na from conversations group by 1) where nu = na) select u.conv_id, u.turn as user_turn, a.turn as assistant_turn from u join a using (conv_id, i) join n using (conv_id)")
def positional_pairing(spark, d):
    c = t(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("role") == r, F.col("turn")))).alias(r) for r in ("user", "assistant")])
    z = g.where(F.size("user") == F.size("assistant")).select("conv_id", F.explode(F.arrays_zip("user", "assistant")).alias("z"))
    return z.select("conv_id", F.col("z.user").alias("user_turn"), F.col("z.assistant").alias("assistant_turn"))


@query("select p_partkey, p_name from part p where not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l.l_quantity > 49)")
def missing_defaults_antijoin(spark, d):
    used = t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("select coalesce(lang, 'TOTAL') lang, cast(sum(quality) as bigint) hits, cast(count(*) as bigint) total, round(sum(quality) * 1.0 / count(*), 6) rate from labels join documents using (doc_id) group by rollup (lang)")
def eval_rollup(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.rollup("lang").agg(F.sum("quality").alias("hits"), F.count("*").alias("total"), F.round(F.sum("quality") / F.count("*"), 6).alias("rate")).withColumn("lang", F.coalesce("lang", F.lit("TOTAL")))


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) median, round(quantile_disc(o_totalprice, 0.5), 4) lower_median from orders group by 1")
def exact_medians(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.expr("percentile_disc(0.5) within group (order by o_totalprice)"), 4).alias("lower_median"))


@query("select l_returnflag, min(l_extendedprice) weighted from (select l_returnflag, l_extendedprice, sum(l_quantity) over (partition by l_returnflag order by l_extendedprice) c, sum(l_quantity) over (partition by l_returnflag) t from lineitem) where c >= t / 2 group by 1")
def weighted_median(spark, d):
    # Weights are summed by value before the window, which then has one row per distinct value.
    g = t(spark, d, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_returnflag")
    c = g.withColumn("c", F.sum("q").over(w.orderBy("l_extendedprice"))).withColumn("t", F.sum("q").over(w))
    return c.where("c >= t / 2").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("weighted"))


@query("select user_id, date_trunc('hour', ts) as h, round(sqrt(avg(value * value)), 6) rms, round(max(abs(value)), 6) peak from events group by all having sqrt(avg(value * value)) >= 0.0001")
def rms_peak_gate(spark, d):
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    return t(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(rms.alias("r"), F.round(F.max(F.abs("value")), 6).alias("peak")).where("r >= 0.0001").select("user_id", "h", F.round("r", 6).alias("rms"), "peak")


@query("select event_id, cast(floor(least(8000.0, 700.0 * pow(2.0, event_id % 7)) * (1 + (event_id % 5) / 4.0 * 0.25) + 0.5) as bigint) delay_ms from events")
def retry_schedule(spark, d):
    return t(spark, d, "events").select("event_id", X.retry_delay(F.col("event_id") % 7, (F.col("event_id") % 5) / 4.0).alias("delay_ms"))


@query("select page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]+)', 1) origin, sha256(regexp_extract(lower(url), '^([a-z]+://[^/?#]+)', 1)) origin_key, starts_with(url, 'https://') safe from pages")
def url_origin_key(spark, d):
    o = captions.origin(F.col("url"))
    return t(spark, d, "pages").select("page_id", o.alias("origin"), F.sha2(o, 256).alias("origin_key"), F.startswith("url", F.lit("https://")).alias("safe"))


@query("select page_id, link, cast(min(pos) as bigint) pos from (select page_id, unnest(ls) link, unnest(range(0, len(ls))) pos from (select page_id, regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1) ls from pages)) group by all")
def html_link_candidates(spark, d):
    return captions.links(t(spark, d, "pages"), "page_id", "html")


@query("select page_id, row_number() over (order by url, page_id) as number, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') as file_name from pages")
def catalog_numbering(spark, d):
    p = t(spark, d, "pages").select("url", "page_id")
    return number_rows(p, ["url", "page_id"]).select("page_id", "number", F.regexp_replace("url", "[^A-Za-z0-9]+", "_").alias("file_name"))


@query("select event_type, cast(count(*) as bigint) n, cast(count(json_extract_string(props, '$.k')) as bigint) n_k, cast(sum(length(props)) as bigint) chars from events group by 1")
def json_props_path(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_k"), F.sum(F.length("props")).alias("chars"))


@query(
    "with " + _LINES + ", c as (select doc_id, l, count(*) n from lines where l <> '' group by all), z as (select doc_id, sum(n * length(l)) chars, sum(n) blocks from c group by 1), "
    "m as (select x.doc_id a, y.doc_id b, sum(least(x.n, y.n) * length(x.l)) common from c x join c y on y.l = x.l and x.doc_id < y.doc_id group by all), "
    "d as (select a, b, round(2.0 * common / (x.chars + y.chars), 6) dice from m join z x on x.doc_id = a join z y on y.doc_id = b where 200 * common >= 72 * (x.chars + y.chars)), "
    "k as (select doc_id, md5(string_agg(l || chr(1) || n, chr(2) order by l)) bag from c group by 1), r as (select bag, min(doc_id) rep from k group by 1) "
    "select a, b, dice from d where a in (select rep from r) and b in (select rep from r) union all select rep as a, doc_id as b, 1.0 from k join r using (bag) where doc_id <> rep"
)
def bag_dice_similarity(spark, d):
    return similar_bags(lines(spark, d).where("l <> ''").select("doc_id", "l"), "doc_id", "l")


_CACHE = "with " + _LINES + ", cur as (select doc_id, line, l from lines where l <> ''), saved as (select doc_id, case when line % 4 = 0 then line else line + 1 end line, l from lines where l <> '' and line % 7 <> 3), one as (select c.doc_id, c.line, c.l from cur c join saved s on c.doc_id = s.doc_id and c.line = s.line and c.l = s.l), "


@query(
    _CACHE + "rc as (select doc_id, line, l, row_number() over (partition by doc_id, l order by line) r from cur c where not exists (select 1 from one o where o.doc_id = c.doc_id and o.line = c.line)), "
    "rs as (select doc_id, line, l, row_number() over (partition by doc_id, l order by line) r from saved s where not exists (select 1 from one o where o.doc_id = s.doc_id and o.line = s.line and o.l = s.l)), two as (select rc.doc_id, rc.line from rc join rs using (doc_id, l, r)) "
    "select doc_id, cast(count(*) filter (tier = 1) as bigint) same_place, cast(count(*) filter (tier = 2) as bigint) same_page, cast(count(*) filter (tier = 0) as bigint) unmatched from (select c.doc_id, case when o.line is not null then 1 when w.line is not null then 2 else 0 end tier from cur c left join (select distinct doc_id, line from one) o using (doc_id, line) left join two w using (doc_id, line)) group by doc_id"
)
def cache_match_three_tier(spark, d):
    cur = lines(spark, d).where("l <> ''")
    saved = lines(spark, d).where("l <> '' and line % 7 <> 3").withColumn("line", F.when(F.col("line") % 4 == 0, F.col("line")).otherwise(F.col("line") + 1))
    one = cur.join(saved, ["doc_id", "line", "l"], "left_semi")
    w = Window.partitionBy("doc_id", "l").orderBy("line")
    rc = cur.join(one, ["doc_id", "line", "l"], "left_anti").withColumn("r", F.row_number().over(w))
    rs = saved.join(one, ["doc_id", "line", "l"], "left_anti").withColumn("r", F.row_number().over(w)).drop("line")
    two = rc.join(rs, ["doc_id", "l", "r"]).select("doc_id", "line", F.lit(2).alias("tier"))
    hit = one.select("doc_id", "line", F.lit(1).alias("tier")).union(two)
    count = lambda k, n: F.count_if(F.coalesce("tier", F.lit(0)) == k).alias(n)
    return cur.join(hit, ["doc_id", "line"], "left").groupBy("doc_id").agg(count(1, "same_place"), count(2, "same_page"), count(0, "unmatched"))


@query(
    "select * from (select conv_id, cast(turn as bigint) as cue, cast(30 * turn as double) as start, cast(30 * turn + 2.5 as double) as \"end\", "
    "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as text from conversations where text is not null) where text <> ''"
)
def captions_parse(spark, d):
    # A cue's body is all lines of a turn; a blank line would end the cue, so blank lines are left out of the file.
    body = F.array_join(F.filter(F.split("text", r"\r\n?|\n"), lambda x: x.rlike(r"\S")), "\n")
    c = t(spark, d, "conversations").withColumn("body", body).where("body <> ''")
    hours = lambda s: F.floor(s / 3600).cast("string")
    stamp = lambda s: F.concat(F.lpad(hours(s), F.greatest(F.length(hours(s)), F.lit(2)), F.lit("0")), F.replace(F.substring(X.srt_time(s), 3, 10), F.lit(","), F.lit(".")))
    cue = F.concat(stamp(30.0 * F.col("turn")), F.lit(" --> "), stamp(30.0 * F.col("turn") + 2.5), F.lit("\n"), F.col("body"))
    files = c.select("conv_id", "turn", F.concat(F.lit("WEBVTT\n\nNOTE made\n\n"), cue).alias("file"))
    return captions.parse_captions(files.withColumn("k", F.struct("conv_id", "turn")), "k", "file").select("k.conv_id", F.col("k.turn").alias("cue"), "start", "end", "text")

"""Queries that run a real stream over a table's files to its end: windows, sessions, folds with state, updates, jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.streaming import live, timers


def turns(spark, d):
    """Turns of conversations in three steps: the first three, the next three, and the rest."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")
    return live.in_parts(c, "session", F.least(F.floor(F.col("seq") / 3), F.lit(2)), 3, "turns")


def events(spark, d):
    """Events in three steps of equal time."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    share = (F.unix_micros("ts") - F.lit(first)) / F.lit(max((last or 0) - (first or 0), 1))
    return live.in_parts(e, "user_id", F.coalesce(F.least(F.floor(share * 3), F.lit(2)), F.lit(0)), 3, "events")


@query("select event_type, time_bucket(interval 1 hour, ts) as start, cast(count(*) as bigint) n, round(sum(value), 4) total from events group by all")
def stream_windows(spark, d):
    w = live.windowed(events(spark, d), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    return live.run_to_end(w, "windows", "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "with s as (select *, case when ts > lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from s) "
    "select user_id, min(ts) as start, cast(count(*) as bigint) n from g group by user_id, k"
)
def stream_sessions(spark, d):
    s = live.sessions(events(spark, d), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return live.run_to_end(s, "sessions", "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


_STEP = "case when quiet then '' when t = '' or dropped then pending when done then '' else joined end"


@query(
    "with recursive c as (select conv_id as session, turn as seq, regexp_replace(trim(coalesce(text, '')), '^\\s+|\\s+$', '', 'g') as t, turn % 7 = 6 as quiet, false as dropped, row_number() over (partition by conv_id order by turn) r from conversations), "
    "j as (select *, t as joined, t <> '' and not quiet and (regexp_matches(t, '[.!?…。！？؟،;:]$') or length(t) >= 160) as done, '' as pending, null::varchar as line from c where r = 1), "
    f"f as (select session, r, {_STEP} as pending, case when quiet then nullif(pending, '') when done then joined end as line, seq from j union all "
    f"select x.session, x.r, {_STEP}, case when quiet then nullif(pending, '') when done then joined end, seq from (select y.*, t <> '' and not quiet and (regexp_matches(joined, '[.!?…。！？؟،;:]$') or length(joined) >= 160) as done from (select c.*, f.pending, trim(f.pending || ' ' || c.t) as joined from f join c on c.session = f.session and c.r = f.r + 1) y) x) "
    "select session, seq as line_seq, md5(line) line from f where line is not null union all select session, seq, md5(line) from (select session, arg_max(seq, r) seq, arg_max(pending, r) line from f group by session) where line <> ''"
)
def stream_committed_lines(spark, d):
    chunks = turns(spark, d).select("session", "seq", "text", F.when(F.col("seq") % 7 == 6, 0.0).otherwise(0.5).alias("rms"))
    return live.run_to_end(live.committed_lines(chunks), "lines").select("session", "line_seq", F.md5("line").alias("line"))


_W = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query(
    f"with w as (select conv_id, turn, {_W} w, list_transform({_W}, lambda x: lower(x)) l, lag(list_transform({_W}, lambda x: lower(x))) over (partition by conv_id order by turn) b from (select conv_id, turn, 'the same words ' || (case when turn % 3 > 0 then 'go on ' else '' end) || text as text from conversations)), "
    "p as (select *, case when b is null then 0 else coalesce(list_min(list_filter(range(1, least(len(l), len(b)) + 1), lambda i: l[i] <> b[i])) - 1, least(len(l), len(b))) end lcp from w), "
    "m as (select *, max(lcp) over (partition by conv_id order by turn) top from p), n as (select *, coalesce(lag(top) over (partition by conv_id order by turn), 0) was from m) select conv_id as session, turn as at_seq, cast(top as bigint) n_committed, md5(array_to_string(w[was + 1:top], ' ')) added, md5(array_to_string(w[top + 1:], ' ')) rest from n"
)
def stream_prefix_confirm(spark, d):
    lead = F.when(F.col("seq") % 3 > 0, "go on ").otherwise("")
    h = turns(spark, d).select("session", "seq", F.concat(F.lit("the same words "), lead, F.coalesce("text", F.lit(""))).alias("text"))
    out = live.run_to_end(live.confirmed(h), "prefix")
    return out.select("session", "at_seq", "n_committed", F.md5("added").alias("added"), F.md5("rest").alias("rest"))


@query("with m as (select conv_id as session, turn // 3 as record, turn as seq, case when turn % 5 = 4 then 'fast-preview' when turn % 3 = 0 then 'source-final' else 'final' end stage, text, case when turn % 3 = 0 then '' when turn % 7 = 1 then ' ' else 'T:' || text end as translation from conversations) select session, record, md5(arg_min(text, seq)) as text, md5(coalesce(arg_max(trim(translation), seq) filter (trim(translation) <> ''), '')) as translation, max(seq) last_seq from m where stage not like '%preview%' group by all")
def stream_final_rows(spark, d):
    seq = F.col("seq")
    stage = F.when(seq % 5 == 4, "fast-preview").when(seq % 3 == 0, "source-final").otherwise("final")
    said = F.when(seq % 3 == 0, "").when(seq % 7 == 1, " ").otherwise(F.concat(F.lit("T:"), "text"))
    m = turns(spark, d).select("session", F.floor(seq / 3).alias("record"), "seq", stage.alias("stage"), "text", said.alias("translation"))
    out = live.latest(live.run_to_end(live.final_rows(m, "session", "record", every=True), "finals"), ["session", "record"])
    return out.select("session", "record", F.md5("text").alias("text"), F.md5(F.coalesce("translation", F.lit(""))).alias("translation"), F.col("at_seq").alias("last_seq"))


@query("with r as (select user_id % 50 as request_id, event_id as seq, event_type as payload from events), f as (select *, first_value(payload) over (partition by request_id order by seq) first, row_number() over (partition by request_id order by seq) n from r) select request_id, job, cast(count(*) as bigint) n from (select request_id, case when n = 1 then 'accepted' when payload = first then 'known' else 'conflict' end job from f) group by all")
def stream_jobs(spark, d):
    r = events(spark, d).select((F.col("user_id") % 50).alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return live.run_to_end(live.submitted_jobs(r), "jobs").groupBy("request_id", "job").agg(F.count("*").alias("n"))


@query(
    "with cues as (select conv_id as session, turn as cue, 7.0 * turn as s, 7.0 * turn + least(9.0, 1 + length(text) / 40.0) as e from conversations), clock as (select distinct conv_id as session, p as seq, 0.5 * p as at from conversations, (select unnest(range(0, 60)) p)), "
    "hit as (select session, seq, coalesce(min(cue), -1) cue from (select c.session, c.seq, q.cue from clock c left join cues q on q.session = c.session and q.s <= c.at and c.at < q.e) group by all) "
    "select session, seq as at_seq, cue from (select *, lag(cue) over (partition by session order by seq) b from hit) where b is null or b <> cue"
)
def active_cue_changes(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    cues = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("cue"), (7.0 * F.col("turn")).alias("start"), (7.0 * F.col("turn") + F.least(F.lit(9.0), 1 + F.length("text") / 40.0)).alias("end"))
    clock = c.select(F.col("conv_id").alias("session")).distinct().withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("at", F.col("seq") * 0.5)
    return live.active_changes(clock, cues)


@query(
    "with w as (select conv_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from conversations), x as (select conv_id, array_to_string(w[1:len(w) // 2], ' ') p, array_to_string(w, ' ') f from w), "
    "l as (select conv_id, unnest([case when length(p) >= 160 or regexp_matches(p, '[.!?…。！？؟;:]$') then p end, nullif(f, '')]) l from x) select conv_id as session, cast(sum(length(l)) as bigint) as chars, cast(count(*) as bigint) as n_lines from l where l is not null group by 1"
)
def stream_whole_captions(spark, d):
    """Each turn grows: first half of its words, then all of them; turns come far apart, the last one waits for the end."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    x = turns(spark, d).withColumn("w", words)
    grown = F.explode(F.array(*[F.struct((2 * F.col("seq") + i).alias("seq"), (F.col("seq") * 10_000 + 500 * i).alias("at"), F.array_join(part, " ").alias("text")) for i, part in enumerate((F.slice("w", F.lit(1), F.floor(F.size("w") / 2).cast("int")), F.col("w")))]))
    out = live.run_to_end(live.buffered_captions(x.select("session", grown.alias("c")).select("session", "c.*")), "captions")
    return out.groupBy("session").agg(F.sum(F.length("line")).alias("chars"), F.count("*").alias("n_lines"))


@query()
def stream_overlap_merge(spark, d):
    """Fragments of ten words, each of which repeats the last four of the one before, give all words of a text again."""
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    more = F.greatest(F.ceil((F.size("w") - 10) / 6), F.lit(0)).cast("int")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), more), lambda i: F.array_join(F.slice("w", 6 * i + 1, F.lit(10)), " ")))
    fragments = c.select(F.concat_ws(":", "conv_id", "turn").alias("session"), cut.alias("seq", "text")).withColumn("seq", F.col("seq").cast("long"))
    out = live.run_to_end(live.merged_fragments(live.in_parts(fragments, "session", F.least(F.floor(F.col("seq") / 4), F.lit(2)), 3, "fragments")), "merged")
    said = out.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_seq", "added"))), lambda x: F.when(x["added"] != "", x["added"])), " ").alias("said"))
    whole = c.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("session"), F.array_join("w", " ").alias("w"))
    return whole.join(said, "session").select("conv_id", "turn", (F.col("said") == F.col("w")).alias("whole"))


def _tried(text: str, context: list[str], tries: int) -> str | None:
    """A model that needs as many tries as the length of a text says, and never manages lengths divisible by 7."""
    return None if len(text) % 7 == 0 or tries < len(text) % 3 else f"{len(text)}/{len(context)}"


@query(
    "with recursive c as (select conv_id as session, turn as seq, 1000 + 1500 * turn as tm, length(text) n, row_number() over (partition by conv_id order by turn) r from conversations where regexp_matches(text, '[^\\s]')), "
    "f as (select session, r, seq, n, tm + case when n % 7 = 0 then 3000 else [0, 1000, 3000][1 + n % 3] end as free, 0 as ctx, n % 7 <> 0 as ok from c where r = 1 union all "
    "select c.session, c.r, c.seq, c.n, greatest(f.free, c.tm) + case when c.n % 7 = 0 then 3000 else [0, 1000, 3000][1 + c.n % 3] end, least(8, f.ctx + cast(f.ok as int)), c.n % 7 <> 0 from f join c on c.session = f.session and c.r = f.r + 1) "
    "select session, seq, 'source-final' stage, '' translation, cast(tm as bigint) as \"at\" from c union all select session, seq, case when ok then 'professional-final' else 'error' end, case when ok then n || '/' || ctx else '' end, cast(free as bigint) from f"
)
def stream_session_queue(spark, d):
    """Turns 1.5 seconds apart go through a session's queue; a try that fails waits longer each time."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), (1000 + 1500 * F.col("turn")).alias("at"), "text")
    rows = timers.closed(c)
    step = F.when(F.col("session") == timers.CLOCK, 3).otherwise(F.least(F.floor(F.col("seq") / 3), F.lit(2)))
    out = live.run_to_end(timers.session_queue(live.in_parts(rows, "session", step, 4, "sentences"), _tried), "queue")
    return out.where(F.col("session") != timers.CLOCK)


@query(
    "with x as (select user_id as session, event_id as seq, epoch_us(ts) // 1000 tm, event_type as text from events where user_id is not null), f as (select *, lag(text) over w b, lead(tm) over w nxt from x window w as (partition by session order by tm, seq)), "
    "g as (select session, tm, text, b is null or b <> text as new from f), h as (select session, tm, text, lead(tm) over (partition by session order by tm) nxt from g where new) "
    "select session, tm + 650 as \"at\", text as caption from h where nxt is null or nxt >= tm + 650"
)
def stream_still_captions(spark, d):
    """Types of events as captions of users: those that no other type follows within 650 ms."""
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timers.closed(e.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").alias("seq"), F.unix_millis("ts").alias("at"), F.col("event_type").alias("text")))
    first, last = rows.where(F.col("session") != timers.CLOCK).agg(F.min("at"), F.max("at")).first()
    step = F.when(F.col("session") == timers.CLOCK, 3).otherwise(F.least(F.floor((F.col("at") - F.lit(first or 0)) * 3 / F.lit(max((last or 0) - (first or 0), 1))), F.lit(2)))
    out = live.run_to_end(timers.still_captions(live.in_parts(rows, "session", step, 4, "captions"), timers.PLAYER_STILL_MS, again=True), "still")
    return out.where(F.col("session") != timers.CLOCK)

"""Queries on work that goes through models: batches that fail and are halved, sessions with an outbox, captured audio. The
models are deterministic stubs that fail by the lengths of what they are asked."""
from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import audio as A
from lectern.operators import batches as B
from lectern.operators.outbox import Outbox
from lectern.plans.registry import query, t
from lectern.shared import fresh
from lectern.streaming import live


def _said(text: str) -> str:
    return f"译文{len(text)}"


def _ask(texts: list[str], depth: int) -> B.Reply:
    """Cannot read a request of several texts with one of a length divisible by 13; leaves out some lengths at first, and
    those divisible by 53 always."""
    if len(texts) > 1 and any(len(x) % 13 == 0 for x in texts):
        return B.Reply(None)
    return B.Reply([(f"t{i}", _said(x)) for i, x in enumerate(texts) if len(x) % 53 and not (depth < 2 and len(x) % 7 == depth)])


def _plain(text: str, mode: str) -> B.Reply:
    if mode == "forced-chunk":
        return B.Reply(None, 503, "no chunks")
    return B.Reply(None, 401, "no key") if len(text) % 53 == 0 else B.Reply(_said(text))


@query(
    "select conv_id, turn, length(coalesce(text, '')) % 53 <> 0 ok, case when length(coalesce(text, '')) % 53 = 0 then 'INCOMPLETE_MODEL_OUTPUT' end code, case when length(coalesce(text, '')) % 53 <> 0 then '译文' || length(text) else '' end translation from conversations"
)
def translation_batches(spark, d):
    """Eight turns of a conversation are a batch; every text that the model can translate is translated in the end."""
    c = t(spark, d, "conversations").withColumn("batch", F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 8)))
    done = B.translate_batches(c, _ask, _plain, pos="turn")
    return done.select(F.split_part("batch", F.lit(":"), F.lit(1)).cast("long").alias("conv_id"), "turn", "ok", "code", "translation")


def _service(request: str, cues: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    return "complete", [(i, f"{len(x)} {x.strip()[:20]}") for i, x in reversed(cues)]


@query("select conv_id as session, turn as seq, md5(case when regexp_matches(coalesce(text, ''), '^ *$') then coalesce(text, '') else regexp_replace(length(text) || ' ' || substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 20), '\\s+$', '') end) as translation, 'complete' status from conversations")
def outbox_translations(spark, d):
    """Turns of conversations as segments, through an outbox to its end."""
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("text").alias("source"), (2.0 * F.col("turn")).alias("start"), (2.0 * F.col("turn") + 1.9).alias("end"))
    done = Outbox(spark, fresh(spark, "outbox")).run(c, _service)
    return done.select("session", "seq", F.md5("translation").alias("translation"), "status")


@query(
    "with s as (select conv_id as session, string_agg(coalesce(text, ''), '' order by turn) x from conversations group by 1), n as (select session, x, length(x) n, (length(x) - 1 + 2) // 3 m from s), "
    "v as (select session, i, unicode(substr(x, cast(3 * i + 1 as bigint), 1)) % 128 * 32767 // 128 v from (select session, x, unnest(range(0, m)) i from n)) "
    "select session, cast(count(*) as bigint) samples, cast(ceil(count(*) / 48000.0) as bigint) chunks, md5(string_agg(printf('%02x%02x', v & 255, v >> 8), '' order by i)) as pcm from v group by session"
)
def stream_audio_chunks(spark, d):
    """Letters as samples of 48 kHz, a turn at a time; a third of them comes out."""
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("x"))
    letters = F.filter(F.split("x", ""), lambda y: y != "")
    # Texts go to the steps' files; their samples, which take eight times as much, are made behind them.
    parts = live.in_parts(c, "session", F.least(F.floor(F.col("seq") / 3), F.lit(2)), 3, "audio")
    pieces = parts.select("session", "seq", F.lit(48_000).alias("rate"), F.transform(letters, lambda y: F.ascii(y) % 128 / 128.0).alias("samples"))
    out = live.run_to_end(A.audio_chunks(pieces), "chunks")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.lower(F.hex("pcm")).alias("h")))), lambda y: y["h"]), "")
    return out.groupBy("session").agg(F.sum(F.length("pcm") / 2).cast("long").alias("samples"), F.count("*").alias("chunks"), F.md5(whole).alias("pcm"))

"""Queries on formats, repairs, layout blocks and small order statistics."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import formats as Y
from lectern.plans.registry import query, t
from lectern.plans.text_queries import _LINES, lines

@query("select event_id, json_extract_string(props, '$.k') is not null has_k, md5(regexp_replace(props, '\\s+', '', 'g')) body from events")
def loose_json_repair(spark, d):
    e = t(spark, d, "events").withColumn("reply", F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```")))
    fixed = Y.loose_json(F.col("reply"))
    return e.select("event_id", F.get_json_object(fixed, "$.k").isNotNull().alias("has_k"), F.md5(F.regexp_replace(fixed, r"\s+", "")).alias("body"))


@query("select p_partkey, lpad(cast(p_partkey % 10000 as varchar), 4, '0') || '-' || case when n = '' then 'untitled' else n end as name from (select p_partkey, regexp_replace(substr(trim(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[<>:\"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80), '[. ]+$', '') n from part)")
def safe_file_names(spark, d):
    return t(spark, d, "part").select("p_partkey", Y.safe_name(F.concat_ws(" / ", "p_name", "p_brand"), F.col("p_partkey") % 10000).alias("name"))


@query("select conv_id, turn, cast(round_even(length(text) * 1.0 / 4, 0) as bigint) as first_len, cast(length(text) as bigint) as total from conversations")
def proportional_split(spark, d):
    parts = Y.split_by_weight(F.col("text"), F.array(*[F.lit(x) for x in (1.0, 2.0, 1.0)]))
    return t(spark, d, "conversations").select("conv_id", "turn", parts.alias("p")).select("conv_id", "turn", F.length(F.col("p")[0]).cast("long").alias("first_len"), F.length(F.array_join("p", "")).cast("long").alias("total"))


@query("select doc_id, substr(text, greatest(p - 200, 1), p - greatest(p - 200, 1) + 4 + 200) ctx from (select doc_id, text, position('that' in text) p from documents) where p > 0")
def context_around_match(spark, d):
    return t(spark, d, "documents").select("doc_id", Y.around(F.col("text"), F.lit("that")).alias("ctx")).where("ctx is not null")


@query("select o_custkey, l[len(l) // 2 + 1] as upper_median from (select o_custkey, list_sort(list(o_totalprice)) l from orders group by 1)")
def upper_medians(spark, d):
    # Values of one key are one array here; keys are customers, whose orders are few.
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v")).select("o_custkey", Y.upper_median(F.col("v")).alias("upper_median"))


_BLOCKS = "blocks as (select doc_id, line // 60 as page, line, l, ((line % 2) * 450 + 20)::double as x, ((line % 60 // 2) * 20)::double as y, (250 + length(l) % 400)::double as w, 18.0::double as h from lines where l <> '')"


@query("with " + _LINES + ", " + _BLOCKS + " select doc_id, line, cast(row_number() over (partition by doc_id order by page, case when x + w / 2 < 450 then 0 else 1 end, y, x, line) as bigint) ord from blocks")
def reading_order(spark, d):
    b = blocks(spark, d)
    column = F.when(F.col("x") + F.col("w") / 2 < 450, 0).otherwise(1)
    return b.select("doc_id", "line", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", column, "y", "x", "line")).cast("long").alias("ord"))


def blocks(spark, d):
    """Positioned blocks made from the lines of documents: two columns of 900-point pages of 60 lines each; the widest reach
    into the other column."""
    b = lines(spark, d).where("l <> ''")
    return b.select("doc_id", F.floor(F.col("line") / 60).alias("page"), "line", "l", ((F.col("line") % 2) * 450.0 + 20).alias("x"), (F.floor(F.col("line") % 60 / 2) * 20.0).alias("y"), (F.length("l") % 400 + 250.0).alias("w"), F.lit(18.0).alias("h"))


@query("with " + _LINES + ", " + _BLOCKS + " select a.doc_id, cast(count(*) as bigint) as n_overlaps, round(sum(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)), 4) width from blocks a join blocks b on a.doc_id = b.doc_id and a.page = b.page and a.y = b.y and a.line < b.line where least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) group by a.doc_id")
def overlapping_blocks(spark, d):
    # Blocks meet by page and baseline, of which each has a few.
    a = blocks(spark, d).select("doc_id", "page", "y", F.col("line").alias("la"), F.col("x").alias("xa"), F.col("w").alias("wa"))
    b = blocks(spark, d).select("doc_id", "page", "y", F.col("line").alias("lb"), F.col("x").alias("xb"), F.col("w").alias("wb"))
    right, left = F.least(F.col("xa") + F.col("wa"), F.col("xb") + F.col("wb")), F.greatest("xa", "xb")
    return a.join(b, ["doc_id", "page", "y"]).where((F.col("la") < F.col("lb")) & (right > left)).groupBy("doc_id").agg(F.count("*").alias("n_overlaps"), F.round(F.sum(right - left), 4).alias("width"))


@query("with " + _LINES + " select doc_id, case when sum(length(l)) < 200 then '' else sha256(string_agg(trim(regexp_replace(l, '\\s+', ' ', 'g')), chr(10) order by line)) end signature from lines where length(l) >= 8 and not regexp_matches(l, '(?i)(licensed|released under|all rights)') group by doc_id")
def stable_signature(spark, d):
    kept = lines(spark, d).where((F.length("l") >= 8) & ~F.col("l").rlike("(?i)(licensed|released under|all rights)"))
    g = kept.groupBy("doc_id").agg(F.sum(F.length("l")).alias("n"), F.sort_array(F.collect_list(F.struct("line", F.trim(F.regexp_replace("l", r"\s+", " ")).alias("x")))).alias("rows"))
    return g.select("doc_id", F.when(F.col("n") < 200, "").otherwise(F.sha2(F.array_join(F.col("rows.x"), "\n"), 256)).alias("signature"))


@query("select page_id, case when starts_with(lower(html), '<!doctype html') then 'html' when starts_with(html, '%PDF-') then 'pdf' else 'other' end kind, hex(encode(substr(html, 1, 4))) magic from pages")
def content_sniff(spark, d):
    kind = F.when(F.startswith(F.lower("html"), F.lit("<!doctype html")), "html").when(F.startswith("html", F.lit("%PDF-")), "pdf").otherwise("other")
    return t(spark, d, "pages").select("page_id", kind.alias("kind"), F.hex(F.substring("html", 1, 4)).alias("magic"))


@query("select source, lang, doc_id from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) r from (select *, row_number() over (partition by source, text order by doc_id) k from documents) where k = 1) where r <= 3")
def select_cases(spark, d):
    first = t(spark, d, "documents").groupBy("source", "text").agg(F.min(F.struct("doc_id", "lang", "n_chars")).alias("x")).select("source", "x.*")
    w = Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    return first.withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "lang", "doc_id")

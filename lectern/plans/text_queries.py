"""Queries on single texts and on dictionary terms."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans.registry import query, t
from lectern.shared import written

#: Ids that are broadcast, counted first.
SMALL_IDS = 100_000


@query(r"select doc_id, cast(len(regexp_extract_all(text, '[A-Z]{2,6}[0-9]{0,4}')) as bigint) acronyms, cast(len(regexp_extract_all(text, '\[[0-9,; -]+\]')) as bigint) citations, cast(len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as bigint) numbers from documents")
def mask_literal_counts(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", X.count(c, r"[A-Z]{2,6}[0-9]{0,4}").alias("acronyms"), X.count(c, r"\[[0-9,; -]+\]").alias("citations"), X.count(c, r"[0-9]+(?:[.,][0-9]+)*").alias("numbers"))


@query()
def mask_roundtrip_ok(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text", X.literals(F.col("text")).alias("v")).withColumn("m", X.masked(F.col("text")))
    return x.select("doc_id", F.size("v").cast("long").alias("literals"), (X.restored(F.col("m"), F.col("v")) == F.col("text")).alias("ok"), X.omits_literal(F.col("m"), F.col("v")).alias("omits"))


@query(r"select doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[ \t\n\r\-]+', ' ', 'g'))) as norm from documents")
def normalize_text_collapse(spark, d):
    # Latin letters with accents, as a fixed table for translate(): no Python is needed for them.
    plain = F.translate(F.lower("text"), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return t(spark, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(plain, r"[ \t\n\r\-]+", " "))).alias("norm"))


@query("select role, cast(count(*) as bigint) n, round(avg(case when regexp_matches(rtrim(text), '[.!?…。！？؟،;:]$') then 1.0 else 0.0 end), 6) rate from conversations group by role")
def ends_sentence_rate(spark, d):
    return t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(X.ends_sentence(F.col("text")).cast("double")), 6).alias("rate"))


@query(
    r"select doc_id, pos, cast(sum(length(s)) over (partition by doc_id order by pos) - length(s) as bigint) as start, cast(length(s) as bigint) len from (select doc_id, unnest(ss) s, cast(unnest(range(0, len(ss))) as bigint) pos from (select doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') ss from documents))"
)
def sentence_split_offsets(spark, d):
    s = F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    e = t(spark, d, "documents").select("doc_id", F.posexplode(s).alias("pos", "s"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), (F.sum(F.length("s")).over(w) - F.length("s")).cast("long").alias("start"), F.length("s").cast("long").alias("len"))


_LINES = "lines as (select doc_id, cast(unnest(range(0, len(ls))) as bigint) line, unnest(ls) l from (select doc_id, string_split(text, chr(10)) ls from documents))"


def lines(spark, d):
    return lines_of(t(spark, d, "documents"))


def lines_of(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).withColumn("line", F.col("line").cast("long"))


def by_own_id(docs):
    """(documents whose id is theirs alone, the others and those without one, or None): only ids are counted, and texts stay where they are unless
    many share an id."""
    shared = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    shared = written(shared, "shared-ids")
    n = shared.count()
    if not n:
        return docs, None
    same = F.broadcast(shared) if n <= SMALL_IDS else shared
    return docs.join(same, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"), docs.join(same, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


@query(
    "with " + _LINES + r""", b as (select doc_id, line, trim(regexp_replace(l, '[ \t]+', ' ', 'g')) x from lines),
m as (select *, regexp_replace(x, ' ', '', 'g') c, len(regexp_extract_all(x, '[A-Za-z][A-Za-z''-]*')) words, len(regexp_extract_all(x, '[-+]?[0-9]+(?:[.,][0-9]+)*')) nums, len(regexp_extract_all(x, '[.!?;:]')) punct from b),
p as (select *, length(c) n, len(regexp_extract_all(c, '[0-9]')) digits, len(regexp_extract_all(c, '[A-Za-z]')) alpha from m),
dense as (select doc_id, count(*) filter (x <> '') >= 90 and quantile_disc(length(x), 0.5) filter (x <> '') <= 30 dense from p group by doc_id)
select doc_id, cast(count(*) as bigint) blocks, cast(count(*) filter (keep) as bigint) preserved, any_value(dense) dense from (select p.doc_id, dense, length(x) < 2 or alpha = 0 or (nums >= 4 and digits >= 0.12 * greatest(1, n)) or (words <= 4 and length(x) <= 24 and upper(x) = x) or alpha < 0.35 * greatest(1, n)
 or (dense and not (length(x) >= 72 and words >= 8 and punct >= 1)) keep from p join dense using (doc_id)) group by doc_id"""
)
def line_blocks_policy(spark, d):
    b = lines(spark, d).select("doc_id", F.trim(F.regexp_replace("l", r"[ \t]+", " ")).alias("x")).withColumn("c", F.replace(F.col("x"), F.lit(" "), F.lit("")))
    n, x, c = F.length("c"), F.col("x"), F.col("c")
    dense = b.groupBy("doc_id").agg(F.count_if(x != "").alias("n_full"), F.expr("percentile_disc(0.5) within group (order by length(x)) filter (where x <> '')").alias("median"))
    dense = dense.select("doc_id", ((F.col("n_full") >= 90) & (F.coalesce("median", F.lit(0)) <= 30)).alias("dense"))
    words, digits, alpha = X.count(x, "[A-Za-z][A-Za-z'-]*"), X.count(c, "[0-9]"), X.count(c, "[A-Za-z]")
    table = (X.count(x, r"[-+]?[0-9]+(?:[.,][0-9]+)*") >= 4) & (digits >= 0.12 * F.greatest(F.lit(1), n))
    ticker = (words <= 4) & (F.length(x) <= 24) & (F.upper(x) == x)
    keep = (F.length(x) < 2) | (alpha == 0) | table | ticker | (alpha < 0.35 * F.greatest(F.lit(1), n)) | (F.col("dense") & ~((F.length(x) >= 72) & (words >= 8) & (X.count(x, "[.!?;:]") >= 1)))
    return b.join(dense, "doc_id").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(keep).alias("preserved"), F.first("dense").alias("dense"))


@query("with " + _LINES + " select cast(count(*) as bigint) n_lines, cast(count(*) filter (" + " or ".join("regexp_matches(l, '(?i)" + p.replace("'", "''") + "')" for p in X.CREDIT_LINES) + ") as bigint) n_credits from lines")
def credit_line_filter(spark, d):
    return lines(spark, d).agg(F.count("*").alias("n_lines"), F.count_if(X.credit_line(F.col("l"))).alias("n_credits"))


_COVER = "select a.conv_id, a.turn, case when len(a.w) < 8 or len(b.w) < 8 then 0.0 else round(len(list_intersect(a.w, b.w)) / len(a.w), 6) end as coverage from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1"


@query("with c as (select conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]{1,}'), lambda x: length(x) > 2)) w from conversations) " + _COVER)
def source_coverage_similarity(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query("select source, cast(sum(ceil((n_chars + 500) / 3.8)) as bigint) tokens_in, cast(sum(ceil(n_chars / 2.4)) as bigint) tokens_out from documents group by source")
def token_usage_estimate(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.sum(F.ceil((F.col("n_chars") + 500) / 3.8)).cast("long").alias("tokens_in"), F.sum(F.ceil(F.col("n_chars") / 2.4)).cast("long").alias("tokens_out"))

"""Queries on the quality of sources and translations, on classes of documents, and on requests."""
from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import classes as C
from lectern.functions import quality as Y
from lectern.operators import checks
from lectern.plans.registry import query, t
from lectern.plans.text_queries import _LINES, lines


def _n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _r(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _bibliography(x: str) -> str:
    return f"({_r(x, Y.REFERENCES)} or {_n(x, Y.NUMBERED)} >= 2 or {_n(x, Y.IDENTIFIER)} >= 2)"


def _metadata(x: str) -> str:
    return f"({_r(x, Y.ADDRESS)} or length({x}) < 70 or {_r(x, Y.NOTICE)} or {_r(x, Y.AUTHORS)} or (contains({x}, '@') and {_r(x, Y.PLACE)}) or {_n(x, Y.AFFILIATION)} >= 2 or {_bibliography(x)})"


def _preserving(x: str, role: str) -> str:
    return f"({x} <> '' and {role} <> 'figure-caption' and ({_bibliography(x)} or {_r(x, Y.ADDRESS_OR_DOI)} or ({_r(x, Y.CONTACT)} and {_r(x, Y.CONTACT_VALUE)}) or {_r(x, Y.NOTICE)} or ({role} = 'metadata' and length({x}) <= 180 and {_r(x, Y.SHORT_METADATA)})))"


def _prose(x: str) -> str:
    latin, han = _n(x, "[A-Za-z]"), _n(x, Y.HAN)
    return f"(length({x}) >= 70 and {latin} >= 45 and {_n(x, Y.ENGLISH_WORD)} >= 8 and {han} < greatest(4.0, {latin} * 0.08) and not {_metadata(x)})"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(nfc_normalize(coalesce({x}, '')), '[­\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), '\\s+', ' ', 'g'))"


#: What stands before each document, so that every rule has texts that it fires on.
LEADS = ("", "References ", "doi: 10.1234/x and https://a.b ", "University of A, Institute of B ", "Downloaded from here ", "Corresponding author e-mail: a@b.org, Department C ", "[1] first. [2] second. ", "访问 IP address 中文中文中文 ")
_LEADS_SQL = "([" + ", ".join("'" + x + "'" for x in LEADS) + "])"
_SOURCES = f"src as (select doc_id, {_clean(_LEADS_SQL + '[1 + doc_id % 8] || coalesce(text, ' + chr(39) * 2 + ')')} x, case when doc_id % 11 = 0 then 'metadata' when doc_id % 13 = 0 then 'figure-caption' else 'body' end as role from documents)"


def sources(spark, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("doc_id") % 8 + 1).cast("int"))
    role = F.when(F.col("doc_id") % 11 == 0, "metadata").when(F.col("doc_id") % 13 == 0, "figure-caption").otherwise("body")
    x = F.concat(lead, F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", Y.normal_source(x).alias("x"), role.alias("role"))


@query(f"with {_SOURCES} select doc_id, {_bibliography('x')} bibliography, {_metadata('x')} metadata, {_preserving('x', 'role')} preserving, {_r('x', Y.VOLATILE)} volatile from src")
def bibliography_metadata_flags(spark, d):
    x = F.col("x")
    return sources(spark, d).select("doc_id", Y.bibliography(x).alias("bibliography"), Y.metadata(x).alias("metadata"), Y.source_preserving(x, F.col("role")).alias("preserving"), Y.volatile(x).alias("volatile"))


@query(f"with {_SOURCES} select doc_id, {_prose('x')} prose from src")
def prose_detector(spark, d):
    return sources(spark, d).select("doc_id", Y.english_prose(F.col("x")).alias("prose"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z][a-z''-]{{1,}}'), lambda w: length(w) > 2))"
_ABC = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
#: Translations of the documents: none, the text, its first three quarters, English words of another kind, Chinese.
_TRANSLATED = (
    f"tr as (select doc_id, x, role, {_clean('y')} y, {_ABC.format('x')} a, {_ABC.format(_clean('y'))} b, {_WORDS.format('x')} wa, {_WORDS.format(_clean('y'))} wb from (select *, case doc_id % 5 when 0 then '' when 1 then x when 2 then substr(x, 1, cast(floor(length(x) * 0.75) as bigint)) when 3 then repeat('other plain English words stand here ', 4) else '译文如果不是这样' || substr(x, 1, 20) end as y from src))"
)
_SMALL, _LARGE = "least(length(a), length(b))", "greatest(length(a), length(b))"
_COPY = f"({_SMALL} >= 55 and (((contains(a, b) or contains(b, a)) and {_SMALL} * 1.0 / greatest({_LARGE}, 1) >= 0.72) or (len(wa) >= 8 and len(wb) >= 8 and len(list_intersect(wa, wb)) * 1.0 / greatest(len(wa), 1) >= 0.84)))"
_ENGLISH = f"({_n('y', Y.HAN)} < 6 and {_n('y', '[A-Za-z]')} >= 35 and {_n('y', Y.ENGLISH_WORD)} >= 7 and {_n('y', '[A-Za-z]')} * 1.0 / greatest({_n('y', '[A-Za-z]')} + {_n('y', Y.HAN)}, 1) >= 0.86)"


def translated(spark, d):
    x = F.col("x")
    y = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, x).when(F.col("doc_id") % 5 == 2, F.substr(x, F.lit(1), F.floor(F.length(x) * 0.75).cast("int"))).when(F.col("doc_id") % 5 == 3, F.repeat(F.lit("other plain English words stand here "), 4)).otherwise(F.concat(F.lit("译文如果不是这样"), F.substring(x, 1, 20)))
    return sources(spark, d).withColumn("y", y)


@query(
    f"with {_SOURCES}, {_TRANSLATED} select doc_id, reason, reason not in ('empty', 'source-copy', 'target-language-missing') valid from (select doc_id, case when y = '' then 'empty' when role = 'metadata' then 'metadata' when {_preserving('x', 'role')} then 'source-preserving' when not {_prose('x')} then 'not-applicable' when {_COPY} then 'source-copy' when {_ENGLISH} then 'target-language-missing' else 'ok' end reason from tr)"
)
def translation_verdict(spark, d):
    return Y.checked(translated(spark, d), "x", "y", role=F.col("role")).select("doc_id", "reason", "valid")


@query(f"with {_SOURCES}, {_TRANSLATED} select doc_id, {_n('x', '[A-Za-z]')} < 20 or {_r('y', Y.HAN)} chinese from tr")
def chinese_translation_flag(spark, d):
    return translated(spark, d).select("doc_id", Y.chinese_translation(F.col("x"), Y.normal_source(F.col("y"))).alias("chinese"))


@query(f"with {_SOURCES}, {_TRANSLATED} " + " union all ".join(f"select doc_id, '{k}' as signal, {_r('y', q)} as kept from tr where {_r('x', p)}" for k, (p, q) in Y.LOGIC.items()))
def logic_signal_retention(spark, d):
    return translated(spark, d).select("doc_id", F.explode(Y.logic_signals(F.col("x"), F.col("y"))).alias("s")).select("doc_id", "s.signal", "s.kept")


# --- Classes of documents ---------------------------------------------------------------------------------------------

_NAMES = "case doc_id % 7 when 0 then 'working paper' when 1 then 'equity research' when 2 then 'morning times' when 3 then 'weekly magazine' when 4 then 'handbook' else 'file' end"
_TEXTS = "case doc_id % 6 when 0 then 'Abstract and methodology. ' when 1 then 'Price target. Risk factors. ' when 2 then 'chapter 1 contents preface ' when 3 then 'financial times ' else '' end || coalesce(text, '')"


def _class_sql() -> str:
    scores = {k: f"{_n(f, p)} * {w}" for k, (f, p, w) in C.KEYWORDS.items()}
    extra = {k: f"case when {_r('name', p)} then {w} else 0 end" for k, (p, w) in C.NAMES.items()}
    extra["academic-paper"] += " + case when outline > 3 then 2 else 0 end"
    extra["newspaper"] += " + two * 5"
    extra["magazine"] += " + three * 6 + images * 2"
    extra["book"] += " + case when pages >= 180 then 5 else 0 end + case when outline >= 20 then 5 else 0 end"
    return ", ".join(f"cast({scores[k]} + {extra[k]} as double) as \"{k}\"" for k in C.KEYWORDS) + ", 1.0::double as generic"


_ORDER = [*C.KEYWORDS, "generic"]
_TOP = "greatest(" + ", ".join(f'"{k}"' for k in _ORDER) + ")"


@query(
    f"with b as (select doc_id, {_NAMES} as name, {_TEXTS} as sample, doc_id % 25 as outline, doc_id % 200 as pages, (doc_id % 3) / 2.0 two, (doc_id % 2) / 2.0 three, (doc_id % 4) / 4.0 images from documents), c as (select *, lower(sample) as low, name || chr(10) || substr(sample, 1, 5000) head from b), "
    f"s as (select doc_id, {_class_sql()} from c) select doc_id, case " + " ".join(f"when \"{k}\" = {_TOP} then '{k}'" for k in _ORDER) + f" end kind, round(least(0.98, greatest(0.45, {_TOP} / ({_TOP} + 7))), 6) confidence from s"
)
def classify_document_scores(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 7 == 0, "working paper").when(i % 7 == 1, "equity research").when(i % 7 == 2, "morning times").when(i % 7 == 3, "weekly magazine").when(i % 7 == 4, "handbook").otherwise("file")
    lead = F.when(i % 6 == 0, "Abstract and methodology. ").when(i % 6 == 1, "Price target. Risk factors. ").when(i % 6 == 2, "chapter 1 contents preface ").when(i % 6 == 3, "financial times ").otherwise("")
    got = C.document_class(F.concat(lead, F.coalesce("text", F.lit(""))), name, pages=i % 200, outline=i % 25, two_columns=(i % 3) / 2.0, three_columns=(i % 2) / 2.0, images=(i % 4) / 4.0)
    return t(spark, d, "documents").select("doc_id", got.alias("c")).select("doc_id", "c.kind", F.round("c.confidence", 6).alias("confidence"))


# --- Blocks: equations, code, volatile texts -----------------------------------------------------------------------------

#: Lines of every seventh place are equations, of every eleventh code; the others are the documents' own.
_MADE = "made as (select doc_id, line, trim(regexp_replace(case when line % 7 = 3 then 'dy/dx = 3x^2 + ' || line || 'x - 1' when line % 11 = 5 then 'def f_' || line || '(x): return x' else l end, '\\s+', ' ', 'g')) l from lines)"


def made_lines(spark, d):
    n = F.col("line").cast("string")
    x = F.when(F.col("line") % 7 == 3, F.concat(F.lit("dy/dx = 3x^2 + "), n, F.lit("x - 1"))).when(F.col("line") % 11 == 5, F.concat(F.lit("def f_"), n, F.lit("(x): return x"))).otherwise(F.col("l"))
    return lines(spark, d).select("doc_id", "line", F.trim(F.regexp_replace(x, r"\s+", " ")).alias("l"))


@query(
    "with " + _LINES + ", " + _MADE + f", m as (select doc_id, line, l, length(regexp_replace(l, '\\s+', '', 'g')) n, {_n('l', C.WORD)} words, {_n('l', C.MATH)} sym, {_n('l', C.BRACKETS)} br, {_n('l', '[0-9]')} dg from made) "
    f"select doc_id, line, cast(sym as bigint) symbols, l <> '' and words <= 24 and {_r('l', C.CODE)} code from m where l <> '' and ((sym >= 2 and (words <= 12 or (sym * 2 + br + dg) * 1.0 / greatest(1, n) >= 0.24)) or (words <= 24 and {_r('l', C.CODE)}))"
)
def equation_like_blocks(spark, d):
    x = F.col("l")
    return made_lines(spark, d).where((x != "") & C.scientific(x)).select("doc_id", "line", Y.matches(x, C.MATH).cast("long").alias("symbols"), C.code_like(x).alias("code"))


# --- Requests --------------------------------------------------------------------------------------------------------------

_CUES = "cues as (select conv_id, turn, case when conv_id % 9 = 4 and turn = 2 then 1 else turn end as id, case when conv_id % 5 = 3 and turn = 1 then '' else text end as text from conversations)"


def cues(spark, d):
    c = F.col("conv_id")
    return t(spark, d, "conversations").select("conv_id", "turn", F.when((c % 9 == 4) & (F.col("turn") == 2), 1).otherwise(F.col("turn")).alias("id"), F.when((c % 5 == 3) & (F.col("turn") == 1), "").otherwise(F.col("text")).alias("text"))


@query("with " + _CUES + " select conv_id, case when count(*) > 24 then 'too many' when count(*) <> count(distinct id) then 'repeated id' when bool_or(trim(coalesce(text, '')) = '') then 'blank' when sum(length(text)) > 12000 then 'too long' else 'ok' end verdict from cues group by 1")
def cue_batch_validation(spark, d):
    return checks.batch_verdict(cues(spark, d), "conv_id", "id", "text", most=24, chars=12_000)


@query("select user_id, case when count(*) > 8000 then 'too many' when count(*) <> count(distinct event_id) then 'repeated id' when bool_or(s < 0 or e <= s or isnan(s)) then 'times' when bool_or(s < before) then 'order' when sum(length(props)) > 4000000 then 'too long' else 'ok' end verdict from (select *, lag(s) over (partition by user_id order by event_id) before from (select user_id, event_id, props, value s, value + 1.5 - case when event_id % 40 = 7 then 2 else 0 end e from events)) group by 1")
def record_validation(spark, d):
    e = t(spark, d, "events").withColumn("s", F.col("value")).withColumn("e", F.col("value") + 1.5 - F.when(F.col("event_id") % 40 == 7, 2).otherwise(0))
    return checks.record_verdict(e, "user_id", "event_id", "s", "e", "props", most=8000, chars=4_000_000)


@query("with c as (select conv_id, turn, (['untranslated', 'term', 'x', 'logic', 'number'])[1 + (conv_id + turn) % 5] reason, case when (conv_id * 7 + turn) % 31 = 0 then 99 else turn end id from conversations where turn % 2 = 0) select conv_id, bool_and(id <> 99) and count(*) = count(distinct id) and bool_and(reason in ('term', 'logic', 'number', 'untranslated')) accepted, cast(count(*) as bigint) n from c group by 1")
def review_flags_validation(spark, d):
    c = t(spark, d, "conversations").where("turn % 2 = 0")
    reason = F.element_at(F.array(*[F.lit(x) for x in ("untranslated", "term", "x", "logic", "number")]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    flags = c.select("conv_id", F.when((F.col("conv_id") * 7 + F.col("turn")) % 31 == 0, 99).otherwise(F.col("turn")).alias("id"), reason.alias("reason"))
    known = c.select("conv_id", F.col("turn").alias("id"))
    return checks.review_verdict(flags, known, "conv_id", "id", "reason", ("term", "logic", "number", "untranslated"))


@query("select conv_id, turn, coalesce(list_bool_or(list_transform(regexp_extract_all(x, 'QS_PROTECTED_([0-9]+)', 1), lambda i: cast(i as int) >= turn % 3)), false) unknown from (select conv_id, turn, text || ' ⟪QS_PROTECTED_' || (turn % 4) || '⟫' x from conversations)")
def unknown_marker_flag(spark, d):
    x = F.concat("text", F.lit(" ⟪QS_PROTECTED_"), (F.col("turn") % 4).cast("string"), F.lit("⟫"))
    return t(spark, d, "conversations").select("conv_id", "turn", checks.unknown_marker(x, F.col("turn") % 3).alias("unknown"))


@query("select event_id, (event_id % 700) in (408, 409, 425, 429, 500, 502, 503, 504) retryable, cast(case when event_id % 3 = 0 then least(15000, greatest(0, (event_id % 40) * 1000)) else floor(least(8000.0, 700.0 * pow(2.0, event_id % 7)) * (1 + (event_id % 5) / 4.0 * 0.25) + 0.5) end as bigint) delay_ms from events")
def retry_decision(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select("event_id", checks.retryable(i % 700).alias("retryable"), checks.retry_after(i % 7, (i % 5) / 4.0, F.when(i % 3 == 0, (i % 40).cast("double"))).alias("delay_ms"))

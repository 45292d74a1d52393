"""Queries on dictionary terms: matching, ranks, rival meanings, checks of translations, dictionaries as data."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.normal import normal_target, normal_term
from lectern.operators import terms as J
from lectern.operators.glossary import evaluate, hotwords, merge_missing, normalized_terms, retired, unambiguous
from lectern.plans.registry import query, t
from lectern.sources import glossary as G

#: A small dictionary of words that the corpora have (id, source, target, domain, aliases, requires_context): "on", "with" and
#: "que" have rival targets, "the" has a generic meaning of its own.
WORDS = [
    (1, "the", "t-the", None, [], False), (2, "and", "t-and", "programming", ["und", "et"], False), (3, "that", "t-that", "programming", ["that's"], False),
    (4, "with", "t-with", "finance", ["avec"], False), (5, "with", "u-with", "statistics", ["mit"], True), (6, "on", "t-on", "finance", ["auf"], False),
    (7, "on", "u-on", "programming", ["en"], False), (8, "der", "t-der", "statistics", ["die", "das"], False), (9, "não-é", "t-nao", "statistics", ["l'on"], True),
    (10, "les", "t-les", "finance", ["los", "le", "la"], False), (11, "que", "t-que", "finance", ["qué"], False), (12, "que", "u-que", "statistics", [], True),
    (13, "THE", "t-article", "finance", [], False), (14, "e-mail", "t-mail", "programming", ["mail"], False), (15, "+1", "t-plus", "programming", ["@"], True),
]


def terms(spark: SparkSession, d: str) -> DataFrame:
    """The words, and the first two to five words of each benchmark passage."""
    fixed = spark.createDataFrame(WORDS, "term_id long, source string, target string, domain string, aliases array<string>, requires_context boolean")
    n = (2 + F.col("item_id") % 4).cast("int")
    b = t(spark, d, "benchmark").withColumn("w", F.split(F.trim("text"), r"\s+"))
    long = b.select((F.col("item_id") + 100).alias("term_id"), F.array_join(F.slice("w", F.lit(1), n), " ").alias("source"), F.concat(F.lit("b"), F.col("item_id")).alias("target"), F.when(F.col("item_id") % 2 == 0, "finance").otherwise("statistics").alias("domain"), F.array(F.array_join(F.slice("w", F.lit(6), n), " ")).alias("aliases"), F.lit(False).alias("requires_context"))
    return fixed.unionByName(long)


def _literal(x) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {_literal(s)}, {_literal(g)}, {_literal(m)}, [{', '.join(map(_literal, a))}]::varchar[], {c})" for i, s, g, m, a, c in WORDS)
TERMS_SQL = (
    f"terms as (select * from (values {_VALUES}) v(term_id, source, target, domain, aliases, requires_context) union all select item_id + 100, array_to_string(w[1:n], ' '), 'b' || item_id, case when item_id % 2 = 0 then 'finance' else 'statistics' end, [array_to_string(w[6:5 + n], ' ')], false "
    "from (select item_id, string_split_regex(trim(text), '\\s+') w, 2 + item_id % 4 n from benchmark))"
)


def _norm(x: str) -> str:
    return f"trim(regexp_replace(translate(replace(lower(strip_accents({x})), '’', ''''), '-–—‑', '    '), '\\s+', ' ', 'g'))"


SPELLINGS_SQL = TERMS_SQL + f", spell as (select distinct term_id, {_norm('a')} alias from (select term_id, unnest(list_distinct(list_prepend(source, aliases))) a from terms) where {_norm('a')} <> '')"
# A match touches no letter a-z and no digit on either side: the rule itself, as a pattern on the whole text.
MATCH_SQL = (
    SPELLINGS_SQL + f", texts as (select doc_id, {_norm('text')} x from documents), m as (select doc_id, s.term_id, alias, cast(length(alias) as bigint) score, source, target, domain, requires_context "
    "from texts join spell s on contains(x, alias) and regexp_matches(x, '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])') join terms using (term_id))"
)


@query("with " + MATCH_SQL + " select doc_id, term_id, source, score, rank from (select *, row_number() over (partition by doc_id order by score desc, term_id) rank from (select doc_id, term_id, source, max(score) score from m group by all)) where rank <= 10")
def term_longest_match_topk(spark, d):
    return J.ranked(J.match_terms(t(spark, d, "documents"), terms(spark, d)), limit=10).select("doc_id", "term_id", "source", "score", "rank")


def _resolved_sql(asked: str, generic: bool) -> str:
    m = "m"
    if generic:
        m = f"(select * from m where domain is null or not exists (select 1 from m o where o.doc_id = m.doc_id and o.domain is null and {_norm('o.source')} = {_norm('m.source')}))"
    skip = " or generic" if generic else ""
    return (
        f", r as (select * from {m}), i as (select doc_id, term_id, domain, max(score) best from r group by all), e as (select doc_id, domain, sum(best) ev from i where domain is not null group by all), "
        f"w as (select r.*, best, coalesce(ev, 0) evidence, coalesce(r.domain = {asked}, false) asked from r join (select doc_id, term_id, best from i) using (doc_id, term_id) left join e on e.doc_id = r.doc_id and e.domain = r.domain), "
        "g as (select doc_id, alias, count(distinct target) targets, max(evidence) top, count(*) filter (asked) asks, bool_or(domain is null) generic from w group by all), "
        "k as (select w.doc_id, w.alias, count(*) tops from w join g using (doc_id, alias) where evidence = top group by all), "
        f"s as (select w.*, (targets <= 1{skip} or case when asks = 1 then asked when tops = 1 then evidence = top else false end) and not (requires_context and w.domain is not null and not asked and evidence - best <= 0) stays from w join g using (doc_id, alias) join k using (doc_id, alias)) "
        "select doc_id, term_id, source, target, any_value(domain) domain, cast(any_value(evidence) as bigint) evidence from s group by doc_id, term_id, source, target having bool_and(stays)"
    )


@query("with " + MATCH_SQL + _resolved_sql("null", False))
def term_conflict_resolution(spark, d):
    return J.resolved(J.match_terms(t(spark, d, "documents"), terms(spark, d))).select("doc_id", "term_id", "source", "target", "domain", "evidence")


@query("with " + MATCH_SQL + _resolved_sql("'statistics'", False))
def term_requested_domain(spark, d):
    return J.resolved(J.match_terms(t(spark, d, "documents"), terms(spark, d)), requested="statistics").select("doc_id", "term_id", "source", "target", "domain", "evidence")


@query("with " + MATCH_SQL + _resolved_sql("null", True))
def term_generic_override(spark, d):
    return J.resolved(J.match_terms(t(spark, d, "documents"), terms(spark, d)), generic_wins=True).select("doc_id", "term_id", "source", "target", "domain", "evidence")


@query("with " + TERMS_SQL + f", c as (select doc_id, term_id, source, row_number() over (partition by doc_id order by length(source) desc, term_id) r from (select doc_id, {_norm('text')} x from documents) join terms on contains(x, {_norm('source')})) select doc_id, term_id, source, r as rank from c where r <= 80")
def term_flat_matches(spark, d):
    # The flat variant: plain containment, no aliases, longest first.
    g = terms(spark, d).select("term_id", "source", normal_term(F.col("source")).alias("alias"))
    m = J.contained(t(spark, d, "documents"), g, "doc_id", "text").join(g, "alias")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.length("source")), "term_id")
    return m.select("doc_id", "term_id", "source").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 80")


_TARGET = "regexp_replace(replace(replace(lower({}), 'ß', 'ss'), '…', '...'), '[\\s\\-–—·•‐‑‒''’]+', '', 'g')"
_ASKED = MATCH_SQL.replace("select doc_id, " + _norm("text") + " x from documents", "select conv_id || ':' || turn doc_id, " + _norm("text") + " x from conversations where role = 'user'")


@query(
    "with " + _ASKED + _resolved_sql("'finance'", False).replace("select doc_id, term_id, source, target, any_value", ", chosen as (select doc_id, term_id, source, target, any_value") + " and any_value(domain) = 'finance'), "
    "said as (select conv_id || ':' || (turn - 1) doc_id, " + _TARGET.format("text") + " x from conversations), f as (select c.doc_id, term_id, bool_or(coalesce(contains(x, a), false)) found from (select c.doc_id, term_id, " + _TARGET.format("unnest(list_distinct(list_prepend(t.source, t.aliases)))") + " a from chosen c join terms t using (term_id)) c left join said s on s.doc_id = c.doc_id group by all) "
    "select doc_id as k, cast(count(*) as bigint) missing from f where not found group by 1"
)
def term_missing_review(spark, d):
    """Turns of the user whose terms of the chosen domain lack in the answer; terms stand for their own targets here."""
    c = t(spark, d, "conversations").withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    asked = c.where("role = 'user'").select("k", "text", "conv_id", "turn")
    chosen = J.resolved(J.match_terms(asked, terms(spark, d), "k"), "k", requested="finance").where("domain = 'finance'").withColumn("target", F.col("source")).withColumn("variants", F.col("aliases"))
    answers = c.select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("k"), F.col("text").alias("answer"))
    missing = J.missing_targets(answers, chosen, "k", "answer")
    return missing.groupBy("k").agg(F.count("*").alias("missing"))


@query("with " + SPELLINGS_SQL + " select alias, cast(count(distinct target) as bigint) n_targets, min(target) target, count(distinct target) = 1 and contains(alias, ' ') and not bool_or(requires_context) safe from spell join terms using (term_id) group by alias")
def safe_term_index(spark, d):
    return J.safe_terms(terms(spark, d))


@query()
def protected_term_spans(spark, d):
    return J.protected_spans(t(spark, d, "documents"), terms(spark, d)).select("doc_id", "n", "start", "end", "target")


@query()
def term_markers(spark, d):
    """Texts with markers for literals and safe terms: how many of each, whether all are kept, and the text by its targets."""
    from lectern.functions.text import restored

    m = J.with_markers(t(spark, d, "documents"), terms(spark, d))
    return m.select("doc_id", F.col("literals").cast("long").alias("literals"), (F.size("values") - F.col("literals")).cast("long").alias("terms"), J.markers_kept(F.col("marked"), F.col("values"), F.col("literals")).alias("kept"), F.md5(restored(F.col("marked"), F.col("values"))).alias("said"))


@query("select p_name as name, p_brand as brand, k, row_number() over (order by k, p_brand, p_partkey) as ord from (select p_partkey, p_name, p_brand, row_number() over (partition by p_brand order by p_partkey) k from (select *, row_number() over (partition by lower(p_name) order by p_partkey) u from part) where u = 1) where k <= 8")
def hotword_round_robin(spark, d):
    p = t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("place"))
    return hotwords(p, "brand", "place", "name", 8).select("name", "brand", "k", "ord")


HINTS = G.DOMAIN_HINTS
_SCORES = [(m, " + ".join(f"(length(x) - length(replace(x, '{h}', ''))) // {len(h)}" for h in hs)) for m, hs in HINTS.items()]
_BEST = "greatest(" + ", ".join(HINTS) + ")"


@query(
    f"select doc_id, case when {_BEST} = 0 then 'academic' " + " ".join(f"when {m} = {_BEST} then '{m}'" for m in HINTS) + f" end as domain, cast({_BEST} as bigint) score from (select doc_id, "
    + ", ".join(f"{s} as {m}" for m, s in _SCORES) + " from (select doc_id, lower(text) || ' ' || (['portfolio', 'runtime class', 'x', 'variance', 'proof bond yield'])[1 + doc_id % 5] as x from documents))"
)
def hint_domain_argmax(spark, d):
    extra = F.element_at(F.array(*[F.lit(x) for x in ("portfolio", "runtime class", "x", "variance", "proof bond yield")]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = t(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.lower("text"), extra).alias("text"))
    return docs.select("doc_id", G.domain_of(F.col("text")).alias("b")).select("doc_id", "b.domain", "b.score")


@query("with " + SPELLINGS_SQL + ", k as (select term_id, lower(trim(source)) src, source, target, domain from terms), f as (select 'conflict' failure, alias item from spell join terms using (term_id) group by alias having count(distinct target) > 1 union all select 'duplicate', src || '|' || coalesce(domain, '') from k group by src, domain having count(*) > 1 union all select 'few terms', coalesce(domain, '') from terms group by domain having count(*) < 5 union all select 'few aliases', coalesce(domain, '') from (select domain, list_filter(aliases, lambda a: trim(a) <> '') a from terms) group by domain having sum(len(a)) < 4) select failure, item from f")
def glossary_gate_failures(spark, d):
    return evaluate(terms(spark, d), least_terms=5, least_aliases=4)


@query("with " + TERMS_SQL + ", f as (select lower(source) s, arg_min(source, term_id) source, arg_min(target, term_id) target, min(term_id) term_id from terms group by 1 having count(distinct target) = 1) select term_id, '\"' || replace(source, '\"', '\"\"') || '\",\"' || replace(target, '\"', '\"\"') || '\"' as line from f")
def csv_quoted_export(spark, d):
    f = unambiguous(terms(spark, d))
    return f.select("term_id", F.to_csv(F.struct("source", "target"), {"quoteAll": "true", "escape": '"'}).alias("line"))


@query("with " + TERMS_SQL + ", u as (select * from terms union all select term_id + 1000, translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), target || '!', domain, aliases, requires_context from terms where term_id % 3 = 0 union all select 9000 + term_id, '  ', target, domain, aliases, requires_context from terms) select term_id, source, target, domain from (select term_id, trim(source) source, trim(target) target, domain, row_number() over (partition by lower(trim(source)), coalesce(domain, '') order by term_id) r from u where trim(source) <> '') where r = 1")
def glossary_first_of_key(spark, d):
    g = terms(spark, d)
    more = g.where("term_id % 3 = 0").select((F.col("term_id") + 1000).alias("term_id"), F.translate("source", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("source"), F.concat("target", F.lit("!")).alias("target"), "domain", "aliases", "requires_context")
    blank = g.select((F.col("term_id") + 9000).alias("term_id"), F.lit("  ").alias("source"), "target", "domain", "aliases", "requires_context")
    return normalized_terms(g.unionByName(more).unionByName(blank)).select("term_id", "source", "target", "domain")


_SAVED = "saved as (select * from terms where term_id % 4 <> 1 or domain is null)"


@query("with " + TERMS_SQL + ", " + _SAVED + f", add_ as (select * from terms p where not exists (select 1 from saved s where s.domain is null and {_norm('s.source')} = {_norm('p.source')}) and not exists (select 1 from saved s where s.domain = p.domain and {_norm('s.source')} = {_norm('p.source')})), u as (select * from saved union all select * from add_) select term_id, source, target from u where not (lower(trim(source)) = 'les' and trim(target) = 't-les')")
def glossary_missing_defaults(spark, d):
    preset = terms(spark, d)
    merged = merge_missing(preset.where("term_id % 4 <> 1 or domain is null"), preset)
    gone = spark.createDataFrame([("LES", "t-les"), ("on", "other")], "source string, target string")
    return retired(merged, gone).select("term_id", "source", "target")


@query("with " + TERMS_SQL + ", l as (select term_id, length('- ' || source || ' => ' || target || case when domain is null then '' else ' [' || domain || ']' end) n, source from terms), r as (select *, sum(n) over (order by length(source) desc, term_id) total from l) select term_id, cast(n as bigint) n from r where total <= 600")
def glossary_prompt_budget(spark, d):
    from lectern.operators.glossary import prompt_lines

    g = terms(spark, d).withColumn("prompt", F.lit(1)).withColumn("aliases", F.lit(None).cast("array<string>"))
    return prompt_lines(g, "prompt", [F.desc(F.length("source")), "term_id"], budget=600).select("term_id", F.length("line").cast("long").alias("n"))


@query("with " + TERMS_SQL + " select domain, target, a as variant from (select domain, target, unnest(list_distinct(list_prepend(target, aliases))) a from terms)")
def target_variants_by_domain(spark, d):
    return terms(spark, d).select("domain", "target", F.explode(F.array_union(F.array("target"), "aliases")).alias("variant"))


@query("select doc_id, md5(" + _TARGET.format("text") + ") as norm from documents")
def normalize_target(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(normal_target(F.col("text"))).alias("norm"))

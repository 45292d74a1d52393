"""Dictionary terms in texts: one pass with an automaton of all spellings, or, where they are too many to be sent to every
task, an equi-join on the token that begins a term; then scores, ranks and the resolution of rival meanings.

A dictionary has term_id, source, target, domain (null: the user's own, generic) and, if given, aliases, variants (accepted
targets), requires_context and strict. Texts and spellings are compared in the form of `normal_term`; a match may not touch
a letter a-z or a digit on either side, so "C++" and "p-value" are terms, and scripts without spaces match anywhere."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.normal import SLICE, normal_target, normal_term

TOKEN = "[a-z0-9]+|[^a-z0-9]"
#: Fields that a dictionary may leave out.
OPTIONAL = {"aliases": "array<string>", "variants": "array<string>", "requires_context": "boolean", "strict": "boolean", "note": "string"}
#: Spellings up to which the dictionary is broadcast; their number is counted.
BROADCAST_SPELLINGS = 50_000


def completed(terms: DataFrame) -> DataFrame:
    """terms with all optional fields."""
    return terms.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in terms.columns})


def spellings(terms: DataFrame) -> DataFrame:
    """(term_id, alias): the distinct normal spellings of each term's source and aliases; empty ones go."""
    every = F.array_union(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))
    return completed(terms).select("term_id", F.explode(every).alias("alias")).select("term_id", normal_term(F.col("alias")).alias("alias")).where("alias <> ''").distinct()


def match_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text, term and spelling that stands in the text: key, all fields of the term, alias, score (its length).
    Both ways give the same rows, and neither shuffles a text."""
    a = spellings(terms)
    known = a.select("alias").distinct()
    n = known.count()
    t = docs.select(key, normal_term(F.col(text)).alias("_x"))
    hit = _by_automaton(t, [r["alias"] for r in known.collect()], key) if n <= BROADCAST_SPELLINGS else _by_first_token(t, known, key)
    small = (lambda x: F.broadcast(x)) if n <= BROADCAST_SPELLINGS else (lambda x: x)
    return hit.join(small(a), "alias").join(small(completed(terms)), "term_id").withColumn("score", F.length("alias").cast("long"))


def _open(x: str, start: int, end: int) -> bool:
    """Whether no letter a-z and no digit touches a place."""
    word = lambda c: c.isascii() and c.isalnum()
    return not (start and word(x[start - 1])) and not (end < len(x) and word(x[end]))


def _scan(texts: DataFrame, spellings: list[str], key: str, of, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """(key, fields): what of(text, [(spelling, start)]) makes of each text (_x), with the places of all spellings found in
    one pass. Spellings are at most BROADCAST_SPELLINGS, counted before they were collected; a task builds its automaton
    once."""
    names = {pa.string(): "string", pa.int64(): "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for s in spellings:
            machine.add_word(s, s)
        machine.make_automaton()
        for b in batches:
            row, found = [], []
            for i, x in enumerate(b.column("_x").to_pylist() if spellings else ()):
                made = of(x, [(s, end + 1 - len(s)) for end, s in machine.iter(x)]) if x else ()
                row += [i] * len(made)
                found += made
            cols = zip(*found, strict=True) if found else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)]], names=[key, *[n for n, _ in fields]])

    return texts.select(key, "_x").mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, " + ", ".join(f"`{n}` {names[k]}" for n, k in fields))


def _by_automaton(texts: DataFrame, spellings: list[str], key: str) -> DataFrame:
    """(key, alias): the spellings that stand in each text (_x)."""
    return _scan(texts, spellings, key, lambda x, places: [(s,) for s in {s for s, i in places if _open(x, i, i + len(s))}], [("alias", pa.string())])


def contained(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "alias") -> DataFrame:
    """(key, alias): the distinct spellings that a text contains, wherever they begin and end, both in their normal form; the
    empty one, which every text contains, included."""
    n = names.select(normal_term(F.col(name)).alias("alias")).where("alias is not null").distinct()
    t = docs.select(key, normal_term(F.col(text)).alias("_x"))
    if n.count() > BROADCAST_SPELLINGS:
        return t.join(n, F.contains("_x", F.col("alias"))).select(key, "alias")
    words = [r["alias"] for r in n.collect()]
    found = _scan(t, [w for w in words if w], key, lambda x, places: [(s,) for s in {s for s, _ in places}], [("alias", pa.string())])
    return found.unionByName(t.where("_x is not null").select(key, F.lit("").alias("alias"))) if "" in words else found


def _from_left(x: str, places: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """Whole-word places of each spelling that do not overlap its own earlier ones."""
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    out, free = [], {}
    for s, i in sorted(places, key=lambda p: p[1]):
        end = i + len(s)
        if i >= free.get(s, 0) and not (i and word(x[i - 1])) and not (end < len(x) and word(x[end])):
            free[s] = end
            out.append((s, i, end))
    return out


def _by_first_token(texts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The same by joins: tokens meet spellings by their first one, as small rows; only where they meet is the text cut, as
    long as that spelling is."""
    a = known.withColumn("first", F.regexp_extract("alias", f"^({TOKEN})", 1))
    most = a.agg(F.max(F.regexp_count("alias", F.lit(TOKEN)))).first()[0] or 0
    t = texts.select(key, F.regexp_extract_all("_x", F.lit(TOKEN), F.lit(0)).alias("_t"))
    here = F.transform("_t", lambda w, i: F.struct(w.alias("first"), F.coalesce(F.get("_t", i - 1), F.lit(" ")).alias("before"), F.array_join(F.slice("_t", i + 1, F.lit(most + 1)), "").alias("rest")))
    starts = t.select(key, F.explode(F.filter(here, lambda x: x["first"] != " ")).alias("x")).select(key, "x.*")
    word = lambda c: c.rlike("^[a-z0-9]")
    open_before = word(F.col("first")) | ~word(F.col("before"))
    open_after = ~word(F.substr(F.col("rest"), F.length("alias") + 1, F.lit(1)))
    return starts.join(a, "first").where(F.startswith("rest", F.col("alias")) & open_before & open_after).select(key, "alias").distinct()


def scored(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per text and term: its longest spelling found counts."""
    fields = [c for c in matches.columns if c not in (key, "term_id", "alias", "score")]
    return matches.groupBy(key, "term_id").agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in fields])


def ranked(matches: DataFrame, key: str = "doc_id", limit: int = 40) -> DataFrame:
    """The best terms of each text: longest spelling first, then in the dictionary's order."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "term_id")
    return scored(matches.repartition(key), key).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def resolved(matches: DataFrame, key: str = "doc_id", requested: Column | str | None = None, generic_wins: bool = False) -> DataFrame:
    """Matches after conflicts, one row per text and term, with `evidence`: the sum of scores of its domain in the text.

    A term that requires context stays only where its domain has other evidence, or is the requested one. Where a spelling
    has several targets, the requested domain's only row wins, else the only row of most evidence; else all of them go.
    With `generic_wins`, terms without a domain replace those of equal source, and their groups are left alone."""
    asked = requested if isinstance(requested, Column) else F.lit(requested).cast("string")
    # Dealt by text once: every window below is within a text, so none of them shuffles again.
    m = matches.repartition(key).withColumn("_asked", F.coalesce(F.col("domain") == asked, F.lit(False)))
    if generic_wins:
        own = F.max(F.col("domain").isNull()).over(Window.partitionBy(key, normal_term(F.col("source"))))
        m = m.withColumn("_own", own).where(F.col("domain").isNull() | ~F.col("_own")).drop("_own")
    term = Window.partitionBy(key, "term_id")
    m = m.withColumn("_best", F.max("score").over(term)).withColumn("_first", F.row_number().over(term.orderBy(F.desc("score"), "alias")) == 1)
    m = m.withColumn("evidence", F.coalesce(F.sum(F.when(F.col("_first") & F.col("domain").isNotNull(), F.col("_best"))).over(Window.partitionBy(key, "domain")), F.lit(0)))
    g = Window.partitionBy(key, "alias")
    m = m.withColumn("_targets", F.size(F.collect_set("target").over(g))).withColumn("_top", F.max("evidence").over(g))
    m = m.withColumn("_tops", F.count_if(F.col("evidence") == F.col("_top")).over(g)).withColumn("_asks", F.count_if("_asked").over(g))
    m = m.withColumn("_generic", F.max(F.col("domain").isNull()).over(g))
    alone = (F.col("_targets") <= 1) | (F.col("_generic") if generic_wins else F.lit(False))
    stays = F.when(alone, True).when(F.col("_asks") == 1, F.col("_asked")).when(F.col("_tops") == 1, F.col("evidence") == F.col("_top")).otherwise(False)
    lone = F.coalesce("requires_context", F.lit(False)) & F.col("domain").isNotNull() & ~F.col("_asked") & (F.col("evidence") - F.col("_best") <= 0)
    m = m.withColumn("_stays", F.min(stays & ~lone).over(term))
    return m.where(F.col("_stays") & F.col("_first")).withColumn("score", F.col("_best")).drop("_asked", "_best", "_first", "_targets", "_top", "_tops", "_asks", "_generic", "_stays")


def missing_targets(pairs: DataFrame, chosen: DataFrame, key: str, translation: str) -> DataFrame:
    """(key, source, target) of terms in `chosen` whose target and variants all lack in the translation of the key."""
    accepted = F.transform(F.array_union(F.array("target"), F.coalesce("variants", F.array().cast("array<string>"))), lambda x: x)
    c = chosen.select(key, "term_id", "source", "target", F.explode(accepted).alias("_a")).withColumn("_a", normal_target(F.col("_a")))
    said = pairs.select(key, normal_target(F.col(translation)).alias("_said"))
    found = c.join(said, key, "left").groupBy(key, "term_id", "source", "target").agg(F.max(F.coalesce(F.contains("_said", F.col("_a")), F.lit(False))).alias("found"))
    return found.where(~F.col("found")).select(key, "source", "target")


def safe_terms(terms: DataFrame) -> DataFrame:
    """(alias, target, n_targets, safe): spellings of several words with one target and no need of context are safe."""
    s = spellings(terms).join(completed(terms).select("term_id", "target", F.coalesce("requires_context", F.lit(False)).alias("_ctx")), "term_id")
    g = s.groupBy("alias").agg(F.countDistinct("target").alias("n_targets"), F.min("target").alias("target"), F.max("_ctx").alias("_ctx"))
    return g.select("alias", "target", "n_targets", ((F.col("n_targets") == 1) & F.contains("alias", F.lit(" ")) & ~F.col("_ctx")).alias("safe"))


def term_spans(docs: DataFrame, names: DataFrame, key: str, text: str, name: str = "alias") -> DataFrame:
    """(key, alias, start, end) of whole-word places of spellings (equal length and case aside) in texts; end is exclusive.
    Places of one spelling do not overlap, and are found from the left."""
    known = names.select(F.lower(name).alias("alias")).where("alias <> ''").distinct()
    t = docs.select(key, F.lower(text).alias("_x"))
    if known.count() <= BROADCAST_SPELLINGS:
        return _scan(t, [r["alias"] for r in known.collect()], key, _from_left, [("alias", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    # Too many for a task: texts meet the spellings whose first token they have, then each pair is searched.
    first = F.regexp_extract("alias", f"^({TOKEN})", 1)
    have = t.select(key, "_x", F.explode(F.array_distinct(F.regexp_extract_all("_x", F.lit(TOKEN), F.lit(0)))).alias("_first"))
    met = have.join(known.withColumn("_first", first), "_first").where(F.contains("_x", F.col("alias")))
    gaps = F.split("_x", F.concat(F.lit(r"(?<!\w)\Q"), F.col("alias"), F.lit(r"\E(?!\w)")), -1)
    e = met.select(key, "alias", F.posexplode(F.slice(gaps, 1, F.size(gaps) - 1)).alias("i", "gap"))
    w = Window.partitionBy(key, "alias").orderBy("i")
    start = F.sum(F.length("gap") + F.length("alias")).over(w) - F.length("alias")
    return e.withColumn("start", start).select(key, "alias", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("alias")).cast("long").alias("end"))


def _chosen(x: str, places: list[tuple[str, int]], blockers: frozenset[str], most: int) -> list[tuple[str, int, int]]:
    """(spelling, start, end) of the first `most` places, the leftmost and there the longest, that neither overlap nor lie
    inside a blocker's place."""
    spans = _from_left(x, places)
    starts, ends = [], []
    for a, z in sorted((a, z) for s, a, z in spans if s in blockers):
        starts.append(a)
        ends.append(max(z, ends[-1]) if ends else z)
    out, free = [], 0
    for a, neg, s in sorted((a, -z, s) for s, a, z in spans if s not in blockers):
        i = bisect_right(starts, a)
        if (not out or free <= a) and not (i and ends[i - 1] >= -neg):
            out.append((s, a, -neg))
            free = -neg
            if len(out) == most:
                break
    return out


def _protected(text: Column, index: DataFrame, most: int) -> Column:
    """array<struct(n, start, end, alias, target)> of protected places in a text, for an index of at most BROADCAST_SPELLINGS."""
    rows = index.select("alias", F.lower("alias").alias("low"), "target", "safe").collect()
    target = {r["alias"]: r["target"] for r in rows if r["safe"]}
    safe = {r["low"] for r in rows if r["safe"]}

    def machine(words) -> ahocorasick.Automaton:
        m = ahocorasick.Automaton()
        for s in words:
            m.add_word(s, s)
        m.make_automaton()
        return m

    places = lambda m, x: [(s, end + 1 - len(s)) for end, s in m.iter(x)]
    inside = machine(safe) if safe else None
    # A longer spelling matters only if it has a safe one inside.
    blockers = frozenset(r["low"] for r in rows if safe and not r["safe"] and r["low"] not in safe and _from_left(r["low"], places(inside, r["low"])))
    kind = pa.list_(pa.struct([("n", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("alias", pa.string()), ("target", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = machine(safe | blockers) if safe else None

        def one(x: str | None) -> list[dict]:
            kept = _chosen(x, places(m, x), blockers, most) if x and m else ()
            return [{"n": n, "start": a, "end": z, "alias": s, "target": target[s]} for n, (s, a, z) in enumerate(kept) if s in target]

        for b in batches:
            parts = [pa.array([one(x) for x in b.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(b), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "array<struct<n:bigint,start:bigint,end:bigint,alias:string,target:string>>")(F.lower(text))


def protected_spans(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """The first `most` places of safe terms of each text, longest first at one place, that do not overlap and do not lie
    inside a longer known spelling."""
    index = safe_terms(terms)
    if index.count() <= BROADCAST_SPELLINGS:
        return docs.select(key, F.explode(_protected(F.col(text), index, most)).alias("x")).select(key, "x.*")
    # Too many for a task: an anti-join of intervals.
    safe = index.where("safe").select("alias", "target")
    longer = index.where("not safe").select(F.col("alias").alias("long"))
    # A longer spelling matters only if it has a safe one inside: found as in any text.
    blockers = term_spans(longer, safe, "long", "long").select(F.col("long").alias("alias")).distinct()
    spans = term_spans(docs, safe, key, text)
    blocked = term_spans(docs, blockers, key, text).select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = spans.join(blocked, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")), "left_anti")
    # Of overlapping places, the leftmost and there the longest stays: a fold over a text's few places.
    g = free.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), "alias"))).alias("x"))
    step = lambda s, x: F.when((F.size(s) == 0) | (-F.element_at(s, -1)["neg"] <= x["start"]), F.concat(s, F.array(x))).otherwise(s)
    kept = F.aggregate("x", F.array().cast("array<struct<start:bigint,neg:bigint,alias:string>>"), step)
    return g.select(key, F.posexplode(F.slice(kept, 1, most)).alias("n", "y")).select(key, F.col("n").cast("long").alias("n"), F.col("y.start").alias("start"), (-F.col("y.neg")).alias("end"), F.col("y.alias").alias("alias")).join(safe, "alias")


def with_markers(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """(key, marked, values, literals): each text with markers for its literals and, numbered on, for the places of safe terms
    outside them; values are what the markers stand for, terms by their targets; literals is how many are no terms."""
    from lectern.functions.text import MARK, literals, masked

    c = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(key, masked(c).alias("_m"), literals(c).alias("_v"))
    index = safe_terms(terms)
    if index.count() <= BROADCAST_SPELLINGS:
        x = base.withColumn("_s", _protected(F.col("_m"), index, most))
    else:
        spans = protected_spans(base, terms, key, "_m", most)
        at = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "target"))).alias("_s"))
        x = base.join(at, key, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<start:bigint,end:bigint,target:string>>")))
    n, size = F.size("_v"), F.size("_s")
    before = lambda i: F.when(i > 0, F.get("_s", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    piece = F.transform("_s", lambda s, i: F.concat(F.substr(F.col("_m"), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.lit(MARK[0]), (n + i).cast("string"), F.lit(MARK[1])))
    tail = F.substr(F.col("_m"), (before(size) + 1).cast("int"), F.length("_m"))
    return x.select(key, F.concat(F.array_join(piece, ""), tail).alias("marked"), F.concat("_v", F.transform("_s", lambda s: s["target"])).alias("values"), n.alias("literals"))


def markers_kept(answer: Column, values: Column, literals: Column) -> Column:
    """Whether an answer has no unknown marker, and the marker of each term exactly once."""
    from lectern.functions.text import once

    found = F.transform(F.regexp_extract_all(answer, F.lit("QS_PROTECTED_([0-9]+)"), F.lit(1)), lambda m: F.coalesce(m.try_cast("int"), F.lit(2**31 - 1)))
    wanted = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: (i >= literals) & (i < n))

    def kept(p: Column) -> Column:
        # Only the marks of terms, which are few, are looked up one by one.
        own = F.filter(p["marks"], lambda m: m >= literals)
        return ~F.exists(p["marks"], lambda m: m >= p["n"]) & once(own, lambda o: F.forall(wanted(p["n"]), lambda i: F.size(F.filter(o, lambda m: m == i)) == 1))

    return once(F.struct(found.alias("marks"), F.size(values).alias("n")), kept)

"""Dictionaries as data: normal rows, merges with presets, gates, prompts, hot words. See `terms` for the fields."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.normal import normal_term
from lectern.operators.terms import completed, spellings

#: Rows that a dictionary may have (fixed value); more is an error, never a cut.
MOST_TERMS = 5000


def capped(rows: DataFrame, most: int, what: str = "rows") -> DataFrame:
    """rows, or an error as soon as they are computed if they are more than `most`: nothing is dropped."""
    n = rows.agg(F.count("*").alias("_n"))
    checked = n.select(F.when(F.col("_n") > most, F.raise_error(F.lit(f"over {most} {what}"))).otherwise(F.lit(0)).cast("int").alias("_ok"))
    return rows.crossJoin(F.broadcast(checked)).where("_ok is null or _ok = 0").drop("_ok")  # one row


def normalized_terms(terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """Trimmed rows with source and target; of equal source (case aside) and domain the first by term_id stays."""
    trim = {c: F.trim(c) for c in ("source", "target", "domain", "note") if c in terms.columns}
    lists = {c: F.filter(F.array_distinct(F.transform(c, lambda x: F.trim(x))), lambda x: x != "") for c in ("aliases", "variants") if c in terms.columns}
    rows = terms.withColumns(trim | lists).withColumn("domain", F.nullif("domain", F.lit(""))).where("source <> '' and target <> ''")
    w = Window.partitionBy(F.lower("source"), F.coalesce("domain", F.lit(""))).orderBy("term_id")
    return capped(rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), most, "terms")


def merge_missing(saved: DataFrame, preset: DataFrame) -> DataFrame:
    """saved, and the preset's rows that neither a generic row of equal source nor one of equal source and domain covers."""
    key = lambda df, *more: df.select(normal_term(F.col("source")).alias("_s"), *more).distinct()
    add = preset.withColumn("_s", normal_term(F.col("source")))
    add = add.join(key(saved.where("domain is null")), "_s", "left_anti")
    add = add.join(key(saved.where("domain is not null"), F.col("domain")), ["_s", "domain"], "left_anti").drop("_s")
    return saved.unionByName(add, allowMissingColumns=True)


def retired(terms: DataFrame, gone: DataFrame) -> DataFrame:
    """terms without the exact pairs (source, case aside, and target) of `gone`; edited translations stay."""
    pair = gone.select(F.lower(F.trim("source")).alias("_s"), F.trim("target").alias("_t")).distinct()
    return terms.join(pair, (F.lower(F.trim("source")) == F.col("_s")) & (F.trim("target") == F.col("_t")), "left_anti")


def migrated(terms: DataFrame, preset: DataFrame, done: list[str], version: str) -> tuple[DataFrame, list[str]]:
    """One step of a migration that runs once per version: (terms, versions done). Missing rows are added, and rows that the
    preset has take its metadata where they have none of their own."""
    if version in done:
        return terms, done
    more = completed(preset).select(normal_term(F.col("source")).alias("_s"), F.trim("target").alias("_t"), *[F.col(c).alias("_p_" + c) for c in ("domain", "note", "aliases", "variants", "requires_context")])
    own = completed(terms).withColumn("_s", normal_term(F.col("source"))).withColumn("_t", F.trim("target")).join(more, ["_s", "_t"], "left")
    own = own.withColumns({c: F.coalesce(c, "_p_" + c) for c in ("domain", "note", "aliases", "variants", "requires_context")})
    return merge_missing(own.drop("_s", "_t", *[c for c in own.columns if c.startswith("_p_")]), completed(preset)), [*done, version]


def unambiguous(terms: DataFrame) -> DataFrame:
    """The first row of each source (case aside) that has one target only."""
    w = Window.partitionBy(F.lower("source"))
    rows = terms.withColumn("_targets", F.size(F.collect_set("target").over(w))).withColumn("_n", F.row_number().over(w.orderBy("term_id")))
    return rows.where("_targets = 1 and _n = 1").drop("_targets", "_n")


def hotwords(lists: DataFrame, group: str, place: str, name: str, depth: int | None = None) -> DataFrame:
    """Names of several ranked lists in turn (all first ones, all second ones, ...), each name once (case aside, its first
    place counts); `k` is the place in its list and `ord` the place in all. With `depth`, only that many of each list."""
    first = lists.withColumn("_u", F.row_number().over(Window.partitionBy(F.lower(F.trim(name))).orderBy(place))).where("_u = 1").drop("_u")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(place)).cast("long"))
    ranked = ranked.where(F.col("k") <= depth) if depth else ranked
    # The order over all lists is dense numbers by ranges, not a window of one partition.
    from lectern.operators.numbering import number_rows

    return number_rows(ranked, ["k", group, place], "ord")


def prompt_lines(terms: DataFrame, key: str, by: list, budget: int = 10_000) -> DataFrame:
    """(key, term_id, line, place): one line per term in order, whole lines only, up to the first that would exceed the
    budget of characters."""
    c = completed(terms)
    tail = F.concat(F.when(F.col("domain").isNotNull(), F.concat(F.lit(" ["), F.col("domain"), F.lit("]"))).otherwise(""), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), F.col("note"), F.lit(")"))).otherwise(""), F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit("; aliases: "), F.array_join("aliases", ", "))).otherwise(""))
    rows = c.withColumn("line", F.concat(F.lit("- "), F.col("source"), F.lit(" => "), F.col("target"), tail))
    w = Window.partitionBy(key).orderBy(*by)
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("_total", F.sum(F.length("line")).over(w))
    return rows.where(F.col("_total") <= budget).select(key, "term_id", "line", "place")


def evaluate(terms: DataFrame, least_terms: int, least_aliases: int) -> DataFrame:
    """(failure, item) of a dictionary: rival targets of a spelling, repeated rows, domains with too few terms or aliases."""
    c = completed(terms)
    s = spellings(terms).join(c.select("term_id", "target"), "term_id")
    fail = lambda df, why, item: df.select(F.lit(why).alias("failure"), item.alias("item"))
    domain = F.coalesce("domain", F.lit(""))
    conflict = s.groupBy("alias").agg(F.countDistinct("target").alias("n")).where("n > 1")
    twice = c.groupBy(F.lower(F.trim("source")).alias("s"), domain.alias("d")).count().where("count > 1")
    sizes = c.groupBy(domain.alias("d")).agg(F.count("*").alias("n"), F.sum(F.size(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a) != ""))).alias("a"))
    return (
        fail(conflict, "conflict", F.col("alias"))
        .union(fail(twice, "duplicate", F.concat_ws("|", "s", "d")))
        .union(fail(sizes.where(F.col("n") < least_terms), "few terms", F.col("d")))
        .union(fail(sizes.where(F.col("a") < least_aliases), "few aliases", F.col("d")))
    )


def check_cases(found: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, expected, forbidden): targets that a case expects and lacks, and those that it forbids and has, from the terms
    found in its text (key, target)."""
    got = found.groupBy(key).agg(F.collect_set("target").alias("_got"))
    c = cases.join(got, key, "left").withColumn("_got", F.coalesce("_got", F.array().cast("array<string>")))
    return c.select(key, F.array_except("expected", "_got").alias("expected"), F.array_intersect("forbidden", "_got").alias("forbidden"))


def requested_domain(value: Column, detected: Column) -> Column:
    """The domain that was asked for; "auto" and blanks mean the one that the text shows."""
    return F.when(F.coalesce(value, F.lit("")).isin("", "auto"), detected).otherwise(value)

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column that rejects a text and computes what it needs itself, beyond the contract's metrics. A
sample of rows, chosen by hash before anything is computed, gives each rule's cost (steps a row: the characters that its
expressions pass over, by the rule's own account, averaged over the sample) and selectivity (share rejected), all of them in
one job; the cascade asks the rule with most rejection per step first and stops at the first that rejects, so what later
rules need is not computed for that text. Steps, unlike seconds, order the rules alike on any machine and in any run. Texts that fail the base ask none. The
verdict is the conjunction of all rules, so the order changes the cost, never the result.

Defined results: a null or empty text has no words and fails the base rule; ties, repeated rows, null ids and further
columns are kept as they are; an empty table gives an empty table. Work per text is O(n log n) in its words, inside one
row: nothing is shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE_CLASS, SPACES, smallest_by_hash

#: Symbols that markup debris leaves (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Steps a character of the expressions that rules use, in units of a translation's: pattern replacement, split into an array.
REPLACE, SPLIT = 4, 3


@dataclass(frozen=True)
class Rule:
    """A named test; `rejects` is true for a text that has to go. It may use the metric columns and `text`. `steps` is what
    it costs on a text, in steps; without it, one for each character."""

    name: str
    rejects: Column
    steps: Column | None = None


def word_list(text: Column) -> Column:
    """Runs of anything but ASCII white space, as an array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def full_lines(body: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; other columns stay."""
    own = [c for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a = docs.select(*[F.col(f"`{c}`") for c in own], body.alias("_q_text"), word_list(F.col(f"`{text}`")).alias("_q_words"))
    size = lambda c: F.length(F.translate(F.col("_q_text"), c, "")).cast("long")
    lines = full_lines(F.col("_q_text"))
    w = F.col("_q_words")
    five = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumns({"_q_lines": lines, "_q_five": five})
    # Only texts in which two hashes agree are looked at by the words themselves: windows with their places, sorted.
    windows = F.when(F.size(F.array_distinct("_q_five")) < F.size("_q_five"), F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]).alias("t"), i.alias("at")))))
    a = a.withColumn("_q_windows", windows)
    v = F.col("_q_windows")
    same = lambda i, j: (j >= 0) & (j < F.size(v)) & F.coalesce(F.get(v, i)["t"] == F.get(v, j)["t"], F.lit(False))
    places = F.transform(F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(v, i)["at"])
    a = a.withColumn("_q_at", F.when(v.isNotNull(), F.sort_array(places)))
    p = F.col("_q_at")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda s, i: s + F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(5))))
    return a.select(
        *[F.col(f"`{c}`") for c in own],
        F.size(w).cast("long").alias("n_words"),
        size(SPACES).alias("word_chars"),
        (F.length("_q_text").cast("long") - size(SYMBOLS)).alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(p.isNotNull() & (F.size(p) > 0), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules beyond the base. All arithmetic is on integers, so any SQL engine gives the same verdict."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    chars, arithmetic = F.length(body), F.lit(1)
    upper = chars - F.length(F.regexp_replace(body, "[A-Z]", ""))
    marks = chars - F.length(F.translate(body, "!?", ""))
    digits = chars - F.length(F.translate(body, "0123456789", ""))
    again = F.col("n_dup_lines") > 0
    long = F.col("n_words") >= 50
    return [
        Rule("symbols", 20 * F.col("n_symbols") > F.col("word_chars"), arithmetic),
        Rule("repeated_lines", again & (10 * F.col("n_dup_lines") > 3 * F.size(full_lines(body))), 1 + F.when(again, SPLIT * chars).otherwise(0)),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), arithmetic),
        Rule("few_distinct_words", long & (100 * F.size(F.array_distinct(word_list(body))) < 8 * F.least(F.col("n_words"), F.lit(2000))), 1 + F.when(long, 2 * SPLIT * chars).otherwise(0)),
        Rule("upper_case", 10 * upper > 3 * F.col("word_chars"), REPLACE * chars),
        Rule("shouting", 2 * marks > F.col("n_words"), chars),
        Rule("digits", 10 * digits > 3 * F.col("word_chars"), chars),
    ]


def cascade_order(docs: DataFrame, rules: Sequence[Rule], text: str = "text", key: str | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, steps a row, share rejected), best rejection per step first, from about `sample_rows` rows of the smallest
    hashes (of `key`, or of the text) whose base does not fail.

    The sample only settles the order of evaluation. Rules that reject nothing there come last, cheapest first; of equals,
    the one that was named first."""
    # Cached, so that metrics are computed once and not anew for each rule; small, and recomputed if an executor goes.
    some = with_metrics(smallest_by_hash(docs, key or text, sample_rows, text).select(text), text).cache()
    whole = F.length(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    asked = [x for r in rules for x in (F.count_if(F.coalesce(r.rejects, F.lit(False))), F.sum(F.coalesce(whole if r.steps is None else r.steps, F.lit(0))))]
    try:
        rows, *found = some.where(~base_failed()).agg(F.count("*"), *asked).first()
    finally:
        some.unpersist()
    measured = [(r, max(steps or 0, 1) / max(rows, 1), out / max(rows, 1)) for r, out, steps in zip(rules, found[::2], found[1::2], strict=True)]
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[1]))


def verdict(ordered: Sequence[Rule]) -> Column:
    """True for a text that no rule rejects; CASE stops at the first rule that does."""
    case = F.when(F.lit(False), F.lit(False))
    for r in ordered:
        case = case.when(F.coalesce(r.rejects, F.lit(False)), F.lit(False))
    return case.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """docs with the metrics, base_failed and kept: false if the base fails or a rule of the cascade rejects. Columns of docs
    that have these names are replaced. `key` only chooses the sample; without such a column the text does."""
    rules = default_rules(text) if rules is None else list(rules)
    ordered = [r for r, _, _ in cascade_order(docs, rules, text, key if key in docs.columns else None)]
    taken = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    measured = with_metrics(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in taken]), text)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(ordered)))

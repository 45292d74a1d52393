"""Model calls behind an interface: a registry of providers, a deterministic stub, batches, and a second pass."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.shared import written

#: A provider takes texts, source and target language, and returns one translation per text (None: failed).
Provider = Callable[[list[str], str, str], list[str | None]]
PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


register("none", lambda texts, source, target: list(texts))
register("stub", lambda texts, source, target: [f"[{target}] {t}" for t in texts])


def translate(rows: DataFrame, text: str, source: str, target: str, provider: str | Provider = "stub", out: str = "translation") -> DataFrame:
    """rows with `out` and `error`. Blank texts and equal languages are passed through without a call; each distinct text of
    a batch is sent once; a failed text keeps its source and has an error."""
    call = PROVIDERS[provider] if isinstance(provider, str) else provider
    kept = rows.drop(out, "error")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            ask = list(dict.fromkeys(t for t in texts if t.strip())) if source != target else []
            said = dict(zip(ask, call(ask, source, target), strict=True)) if ask else {}
            pdf[out] = [said.get(t) or t for t in texts]
            pdf["error"] = ["failed" if t in said and said[t] is None else None for t in texts]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{schema}, `{out}` string, error string")


def second_pass(rows: DataFrame, flagged: str, text: str, source: str, target: str, provider: str | Provider = "stub", out: str = "translation") -> DataFrame:
    """Only rows that are flagged go to the provider again; the others keep what they have."""
    again = translate(rows.where(F.coalesce(F.col(flagged), F.lit(False))), text, source, target, provider, out)
    return rows.where(~F.coalesce(F.col(flagged), F.lit(False))).withColumn("error", F.lit(None).cast("string")).unionByName(again, allowMissingColumns=True)


#: Texts that are tried with markers of terms before all are (a documented bound).
CANARIES = 200


def translate_with_terms(rows: DataFrame, terms: DataFrame, key: str, text: str, source: str, target: str, provider: str | Provider = "stub", canaries: int = CANARIES) -> DataFrame:
    """(key, translation, way, error): literals and safe terms are sent as markers and put back. An answer whose markers are
    damaged is asked for once more with literals only ("plain"). A model that damages markers must not double every call, so
    the texts of the `canaries` smallest hashes go first: if one of theirs is damaged, no other text is sent with terms
    ("bypassed"). way: terms, literals (no terms in the text), plain or bypassed. A literal that an answer lost is an error."""
    from lectern.functions.text import masked, omits_literal, restored
    from lectern.operators.terms import markers_kept, with_markers

    own = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    marked = with_markers(own, terms, key, "_text").join(own, key).withColumn("_terms", F.size("values") > F.col("literals"))
    marked = written(marked, "marked")
    placed = marked.where("_terms").select(F.xxhash64(key).alias("h")).orderBy("h").limit(canaries)
    cut = placed.agg(F.max("h")).first()[0]
    cut = -(2**63) if cut is None else cut

    def sent(some: DataFrame, what: str) -> DataFrame:
        return written(translate(some, what, source, target, provider), "sent")

    kept = markers_kept(F.col("translation"), F.col("values"), F.col("literals"))
    first = F.col("_terms") & (F.xxhash64(key) <= F.lit(cut))
    tried = sent(marked.where(first), "marked").withColumn("_kept", kept & F.col("error").isNull())
    bypass = not tried.where("not _kept").isEmpty()
    rest = marked.where(~first)
    done = tried
    if not bypass:
        done = tried.unionByName(sent(rest.where("_terms"), "marked").withColumn("_kept", kept & F.col("error").isNull()))
    again = done.where("not _kept").select(*marked.columns).withColumn("way", F.lit("plain"))
    others = rest.where("not _terms").withColumn("way", F.lit("literals"))
    if bypass:
        others = others.unionByName(rest.where("_terms").withColumn("way", F.lit("bypassed")))
    others = sent(again.unionByName(others).withColumn("values", F.slice("values", F.lit(1), F.col("literals"))).withColumn("plain", masked(F.col("_text"))), "plain")
    out = done.where("_kept").withColumn("way", F.lit("terms")).select(key, "translation", "values", "way", "error").unionByName(others.select(key, "translation", "values", "way", "error"))
    lost = omits_literal(F.col("translation"), F.col("values"))
    return out.select(key, restored(F.col("translation"), F.col("values")).alias("translation"), "way", F.when(lost, "literal lost").otherwise(F.col("error")).alias("error"))


"""Dictionaries from files and texts, and back: JSON per domain, CSV with quotes, versioned JSON; domains of texts."""
from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.terms import completed

#: Hints of each domain (fixed values): a domain's score is how often its hints occur in a text, as substrings.
DOMAIN_HINTS = {
    "finance": ("portfolio", "asset", "bond", "equity", "valuation", "yield", "coupon", "cash flow", "balance sheet"),
    "quant_finance": ("factor", "alpha", "beta", "backtest", "drawdown", "sharpe", "exposure", "hedging", "martingale measure"),
    "economics": ("inflation", "utility", "equilibrium", "elasticity", "monetary", "fiscal", "unemployment", "gross domestic product"),
    "statistics": ("estimator", "regression", "variance", "likelihood", "hypothesis", "stationary", "p-value", "standard error"),
    "mathematics": ("theorem", "proof", "lemma", "matrix", "eigenvalue", "integral", "sigma-algebra", "brownian motion"),
    "programming": ("function", "class", "runtime", "compiler", "thread", "repository", "dataframe", "exception", "api endpoint"),
}
DEFAULT_DOMAIN = "academic"
TERM = "source string, target string, note string, aliases array<string>, targetVariants array<string>, requiresContext boolean, strict boolean"


def domain_of(text: Column) -> Column:
    """struct(domain, score): the domain of most hints, the first of equals, or the default one without any."""
    low = F.lower(text)
    count = lambda h: F.floor((F.length(low) - F.length(F.replace(low, F.lit(h), F.lit("")))) / len(h)).cast("long")
    scores = [F.struct(sum((count(h) for h in hs[1:]), count(hs[0])).alias("score"), F.lit(-i).alias("ord"), F.lit(m).alias("domain")) for i, (m, hs) in enumerate(DOMAIN_HINTS.items())]
    best = F.array_max(F.array(*scores))
    return F.struct(F.when(best["score"] > 0, best["domain"]).otherwise(DEFAULT_DOMAIN).alias("domain"), best["score"].alias("score"))


def _rows(df: DataFrame) -> DataFrame:
    """File rows with the names of `terms`; term_id follows file and place, the domain is the file's name."""
    e = df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("domain"), F.col("_metadata.file_path").alias("_f"), *[F.col(c) for c in ("source", "target", "note", "aliases", "requiresContext", "strict")], F.col("targetVariants").alias("variants"), F.monotonically_increasing_id().alias("_at"))
    from lectern.operators.numbering import number_rows

    return number_rows(e.withColumnRenamed("requiresContext", "requires_context"), ["_f", "_at"], "term_id").drop("_f", "_at")


def read_glossary(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    """The terms of one domain's file, a JSON array; an unknown domain is read as the default one."""
    files = {r["d"]: r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("d")).collect()}
    return _rows(spark.read.schema(TERM).json(files.get(domain, files[DEFAULT_DOMAIN]), multiLine=True))


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of all files. A row without source or target, or one source (case aside) twice in a domain, is an error."""
    rows = _rows(spark.read.schema(TERM).option("pathGlobFilter", "*.json").json(folder, multiLine=True))
    bad = rows.where(F.trim(F.coalesce("source", F.lit(""))).eqNullSafe("") | F.trim(F.coalesce("target", F.lit(""))).eqNullSafe("")).select("domain", F.coalesce("source", F.lit("")).alias("s"))
    twice = rows.groupBy("domain", F.lower(F.trim("source")).alias("s")).count().where("count > 1").select("domain", "s")
    wrong = [f"{r['domain']}:{r['s']}" for r in bad.union(twice).limit(20).collect()]
    if wrong:
        raise ValueError(f"blank or repeated terms: {', '.join(wrong)}")
    return rows


_HEADER = re.compile("^(source|term|英文|原文)$", re.I)
PARSED = "source string, target string, domain string, note string, aliases array<string>, variants array<string>, requires_context boolean"


def _parse(text: str, form: str) -> list[tuple]:
    text = (text or "").lstrip("﻿").strip()
    if not text:
        return []
    if "json" in (form or "").lower() or text[0] in "[{":
        found = json.loads(text)
        found = found if isinstance(found, list) else found.get("terms") or found.get("glossaryTerms") or []
        said = lambda x, *names: next((str(x[n]) for n in names if x.get(n) is not None), "")
        rows = [(*x[:2], None, None, [], [], False) if isinstance(x, list) else (said(x, "source", "term"), said(x, "target", "translation"), x.get("domain"), x.get("note"), x.get("aliases") or [], x.get("targetVariants") or [], x.get("requiresContext") is True) for x in found]
    else:
        cells = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
        at = {"domain": 2, "note": 3, "aliases": 4, "requirescontext": 5}
        if cells and _HEADER.match(cells[0][0].strip()):
            head = [c.strip().lower() for c in cells.pop(0)]
            at = {k: head.index(k) if k in head else -1 for k in at}
        get = lambda r, k: r[at[k]] if 0 <= at[k] < len(r) else ""

        def aliases(x: str) -> list[str]:
            try:
                return json.loads(x) if x.strip() else []
            except ValueError:
                return x.split("|")

        rows = [(r[0], r[1] if len(r) > 1 else "", get(r, "domain"), get(r, "note"), aliases(get(r, "aliases")), [], get(r, "requirescontext").strip().lower() in ("1", "true", "yes")) for r in cells]
    return rows


def parse_glossary_text(texts: DataFrame, key: str, text: str, form: Column | None = None) -> DataFrame:
    """(key, term_id, fields) of dictionaries kept as texts: CSV with quotes, doubled quotes and an optional header (aliases
    as JSON or split by |), or JSON (an array, or an object with terms). Row numbers are the term ids; rows are then best
    passed through `normalized_terms`. A text that is neither is an error; null and blank texts have no terms."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(k, i, *r) for k, x, f in zip(pdf["_k"], pdf["_x"], pdf["_f"], strict=True) for i, r in enumerate(_parse(x, f), 1)]
            yield pd.DataFrame(rows, columns=["_k", "term_id", "source", "target", "domain", "note", "aliases", "variants", "requires_context"])

    kind = dict(texts.dtypes)[key]
    got = texts.select(F.col(key).alias("_k"), F.col(text).alias("_x"), (form if form is not None else F.lit("")).alias("_f")).mapInPandas(run, f"_k {kind}, term_id long, {PARSED}")
    return got.withColumnRenamed("_k", key)


def glossary_csv(terms: DataFrame) -> DataFrame:
    """One row (csv): a mark of byte order, a header, one quoted line per term in order, lines ended by CR LF. A dictionary
    has few rows by contract, so it is one value."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    c = completed(terms)
    line = F.concat_ws(",", cell(F.col("source")), cell(F.col("target")), cell(F.col("domain")), cell(F.col("note")), cell(F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.to_json("aliases"))), cell(F.when(F.coalesce("requires_context", F.lit(False)), "true")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("term_id", line.alias("line")))), lambda x: x["line"])
    return c.agg(F.concat(F.lit("﻿source,target,domain,note,aliases,requiresContext\r\n"), F.array_join(lines, "\r\n")).alias("csv"))


def glossary_json(terms: DataFrame) -> DataFrame:
    """One row (json): version 2, and the terms in order without what they lack."""
    c = completed(terms)
    some = lambda x: F.when(F.size(x) > 0, x)
    row = F.struct("term_id", F.struct("source", "target", "domain", "note", some(F.col("aliases")).alias("aliases"), some(F.col("variants")).alias("targetVariants"), F.when(F.col("requires_context"), True).alias("requiresContext")).alias("x"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])
    return c.agg(F.to_json(F.struct(F.lit(2).alias("version"), rows.alias("terms"))).alias("json"))

"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, modulo 97 for IBANs, ranges for addresses),
and words near a span adjust its score. The patterns are possessive and anchored behind, so that a run of a million
letters or digits is read once; offsets count code points.

Defined results: a null or empty text has no spans; a text of any length is read whole; other columns stay as they are;
an empty table gives an empty table. All work is inside one row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds, equal in what they match to the plain ones in the contract.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further kinds: account numbers with a modulo-97 check, and identity numbers that only their context can confirm.
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Context words (fixed values): within WINDOW code points before or after, one raises the score of a kind.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|host|server|address)\b",
    "card": r"(?i)\b(card|visa|credit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b",
    "identity": r"(?i)\b(ssn|social security|identity|taxpayer)\b",
}
WINDOW = 40
#: Score without context; a validator that passed is worth more than a shape. Spans under THRESHOLD are dropped.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "identity": 0.3}
LIFT, THRESHOLD = 0.3, 0.5
BASE, EXTRA = ("email", "ip", "card", "phone"), ("iban", "identity")
BLOCK = 128


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass Luhn's check."""
    from_right = F.split(F.reverse(number), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5))
    return F.aggregate(F.transform(from_right, value), F.lit(0).cast("long"), lambda s, x: s + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an IBAN's check digits hold."""
    plain = F.translate(account, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0).cast("int"), step) == 1


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(s, r"\."), part)
    if kind == "card":
        n = F.length(digits(s))
        return F.when((n >= 13) & (n <= 19), luhn(digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    if kind == "iban":
        return F.length(F.translate(s, " ", "")).between(15, 34) & mod97(s)
    return F.lit(True)


def _validator(kind: str, field: str | None = None):
    """valid() of a kind as a function of one column, as filter() and exists() ask for."""
    return lambda x: valid(kind, x[field] if field else x)


def _starts(parts: Column) -> Column:
    """Running starts of matches from parts of struct(gap, len): sums in blocks, then over blocks; no quadratic append."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y["gap"] + y["len"])
    return F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("base"), F.array().cast("array<array<int>>").alias("out")),
        lambda s, x: F.struct(
            (s["base"] + total(x)).alias("base"),
            F.concat(
                s["out"],
                F.array(
                    F.aggregate(
                        x,
                        F.struct(s["base"].alias("at"), F.array().cast("array<int>").alias("out")),
                        lambda a, y: F.struct((a["at"] + y["gap"] + y["len"]).alias("at"), F.concat(a["out"], F.array(a["at"] + y["gap"])).alias("out")),
                        lambda a: a["out"],
                    )
                ),
            ).alias("out"),
        ),
        lambda s: F.flatten(s["out"]),
    )


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "identity": IDENTITY}
#: A text without this character, or without such a short run, can't hold a match: most texts skip the longer search.
NEEDS = {"email": "@", "phone": "+"}


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `pii`: array of (kind, start, end, score, value), by kind as listed, then by start; end is exclusive."""
    own = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("_p_") and c != "pii"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kinds = [*BASE, *EXTRA]
    found = {}
    for k in kinds:
        hits = F.regexp_extract_all(F.col("_p_text"), F.lit(PATTERNS[k]), F.lit(0))
        found[f"_p_hit_{k}"] = F.when(F.contains(F.col("_p_text"), F.lit(NEEDS[k])), hits) if k in NEEDS else hits
    out = docs.select(*own, body.alias("_p_text")).withColumns(found)
    # Gaps between matches give their places; only texts with a valid match are split.
    ok = {f"_p_ok_{k}": F.exists(F.col(f"_p_hit_{k}"), _validator(k)) for k in kinds}
    out = out.withColumns(ok)
    parts = {}
    for k in kinds:
        gaps = F.split(F.col("_p_text"), PATTERNS[k], -1)
        hits = F.col(f"_p_hit_{k}")
        pair = lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value"))
        parts[f"_p_part_{k}"] = F.when(F.col(f"_p_ok_{k}"), F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, pair))
    out = out.withColumns(parts).withColumns({f"_p_start_{k}": F.when(F.col(f"_p_ok_{k}"), _starts(F.col(f"_p_part_{k}"))) for k in kinds})
    spans = []
    for k in kinds:
        kind = F.lit(k)
        span = lambda p, s: F.struct(kind.alias("kind"), s.alias("start"), (s + p["len"]).alias("end"), p["value"].alias("value"))
        good = F.filter(F.zip_with(F.col(f"_p_part_{k}"), F.col(f"_p_start_{k}"), span), _validator(k, "value"))
        around = lambda x: F.concat_ws(" ", F.substr(F.col("_p_text"), F.greatest(x["start"] - WINDOW, F.lit(0)) + 1, F.least(x["start"], F.lit(WINDOW))), F.substr(F.col("_p_text"), x["end"] + 1, F.lit(WINDOW)))
        score = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.least(F.lit(1.0), F.lit(SCORE[k]) + F.when(around(x).rlike(CONTEXT[k]), F.lit(LIFT)).otherwise(F.lit(0.0))).alias("score"), x["value"].alias("value"))
        scored = F.transform(good, score)
        if k not in BASE:
            scored = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
        spans.append(F.coalesce(scored, F.array().cast("array<struct<kind:string,start:int,end:int,score:double,value:string>>")))
    keep = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("_p_") and c != "pii"]
    return out.select(*keep, F.concat(*spans).alias("pii"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of `pii` replaced by <KIND>; where spans of several kinds overlap, they become one mark, named
    for the span that begins first. Only texts with spans are rebuilt."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ordered = F.array_sort(F.transform(F.col("pii"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    # One pass merges overlaps; blocks keep the append cheap for texts with many spans.
    step = lambda s, x: F.when(
        (F.size(s) > 0) & (F.element_at(s, -1)["end"] > x["start"]),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["start"].alias("start"), F.greatest(F.element_at(s, -1)["end"], x["end"]).alias("end"), F.element_at(s, -1)["kind"].alias("kind")))),
    ).otherwise(F.concat(s, F.array(x)))
    merged = F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,kind:string>>"), step)
    a = docs.withColumn("_r_spans", F.when(F.size("pii") > 0, merged))
    m = F.col("_r_spans")
    before = lambda x, i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
    pieces = F.transform(m, lambda x, i: F.concat(F.substr(body, before(x, i) + 1, x["start"] - before(x, i)), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    whole = F.concat(F.array_join(pieces, ""), F.substr(body, F.element_at(m, -1)["end"] + 1))
    return a.withColumn(text, F.when(m.isNotNull(), whole).otherwise(F.col(f"`{text}`"))).drop("_r_spans")

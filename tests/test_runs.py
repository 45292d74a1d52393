"""Runs, units of translation and their way back against plain loops."""
import random
import re

from lectern.operators import runs as R
from pyspark.sql import functions as F


def test_runs_cross_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(90)) for k in (1, 2, None) for i in range(100)]
    rng.shuffle(rows)
    got = {(r["k"], r["i"]): r["batch"] for r in R.greedy_batches(spark.createDataFrame(rows, "k long, i long, n int"), "k", "i", F.col("n"), 5, 200).collect()}
    for k in (1, 2, None):
        n = size = batch = 0
        for i, s in sorted((i, s) for x, i, s in rows if x == k):
            if n and (n >= 5 or size + s > 200):
                n, size, batch = 0, 0, batch + 1
            n, size = n + 1, size + s
            assert got[k, i] == batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def blocks(rng, n):
    texts = ["goes on and on without a mark", "It ends here.", "ALL CAPS HEAD", "1.2 A head", "references and more", "", "(starts low", "more words " * 30]
    roles = ["body"] * 6 + ["heading", "figure-caption", "metadata", None]
    return [(1, i // 6, i, i, rng.choice([10.0, 20.0, 500.0]), rng.choice([80.0, 300.0]), rng.choice(texts), rng.choice(roles), rng.random() < 0.05) for i in range(n)]


def by_hand(rows, across, most):
    units = []
    for r in rows:
        _, page, block, _, x, width, text, role, keep = r
        text = " ".join(text.split())
        apart = role in R.APART or keep or bool(re.match(r"(?i)(?:references|bibliography)\b", text))
        ok = False
        if units:
            p = units[-1]["rows"][-1]
            a = p["text"]
            crossed = p["page"] != page
            ok = not (apart or p["apart"] or not a or not text or len(a) + len(text) > most or a[-1:] in ".!?。！？;；:：”’])}")
            ok = ok and not re.fullmatch(r"[A-Z][A-Z\s\d&-]{4,}", text) and not re.match(r"\d+(?:\.\d+)*\s+[A-Z]", text)
            ok = ok and ((across and bool(re.match(r"[a-z(\[“‘]", text))) if crossed else abs(p["x"] - x) <= max(58, min(p["width"], width) * 0.55))
            ok = ok and len(units[-1]["text"]) + len(text) + 1 <= most
        row = {"page": page, "block": block, "text": text, "x": x, "width": width, "apart": apart}
        if ok:
            units[-1]["rows"].append(row)
            units[-1]["text"] += " " + text
        else:
            units.append({"rows": [row], "text": text})
    return [([x["block"] for x in u["rows"]], u["text"], sorted({x["page"] for x in u["rows"]})) for u in units]


def test_units(spark):
    rng = random.Random(2)
    rows = blocks(rng, 300)
    df = spark.createDataFrame(rows, "doc long, page long, block long, place long, x double, width double, text string, role string, preserve boolean")
    for kind, (across, most) in R.UNITS.items():
        got = [(r["blocks"], r["text"], r["pages"]) for r in R.translation_units(df, kind=F.lit(kind)).orderBy("unit").collect()]
        assert got == by_hand(rows, across, most) and max(len(b) for b, *_ in got) > 2
    assert any(len(p) > 1 for *_, p in by_hand(rows, True, 2600)) and R.translation_units(df.limit(0)).count() == 0


def divided(text, members):
    if len(members) <= 1:
        return [text]
    sentences = [s for s in re.findall(r"[^。！？.!?]+[。！？.!?]?\s*", text) if s.strip()] or [text]
    total = sum(map(len, members)) or len(members)
    share = [len(m) / total * len(text) for m in members]
    out, at, used = [""] * len(members), 0, 0
    for s in sentences:
        if at < len(members) - 1 and used >= sum(share[: at + 1]) - 1e-9:
            at += 1
        out[at] += s
        used += len(s)
    if all(x.strip() for x in out):
        return [x.strip() for x in out]
    said, off, parts = text.strip(), 0, []
    for i, m in enumerate(members):
        a, z = int(off / total * len(said) + 0.5), len(said) if i == len(members) - 1 else int((off + len(m)) / total * len(said) + 0.5)
        parts.append(said[a : max(a + 1, z)].strip() or "…")
        off += len(m)
    return parts


def test_the_way_back(spark):
    rng = random.Random(3)
    cases = [("译文。第二句！第三句很长很长很长。", ["one", "two two", "three three three"]), ("no marks at all here", ["a", "b", "c"]), ("x", ["a", "b", "c"]), ("One. Two.", ["only"]), ("A. B.", ["", ""])]
    cases += [("".join(rng.choice(["word ", "end. ", "句子。", "what? "]) for _ in range(rng.randint(1, 14))).strip(), ["m" * rng.randint(0, 20) for _ in range(rng.randint(1, 5))]) for _ in range(150)]
    df = spark.createDataFrame(cases, "text string, members array<string>").withColumn("got", R.divided(F.col("text"), F.col("members")))
    for r in df.collect():
        assert r["got"] == divided(r["text"], r["members"]), r
    units = spark.createDataFrame([(1, 0, [4, 5], ["ab", "cd"]), (1, 1, [6], ["x"])], "doc long, unit long, blocks array<long>, members array<string>")
    said = spark.createDataFrame([(1, 0, " First.  Second. "), (1, 1, "  ")], "doc long, unit long, translation string")
    assert [tuple(r) for r in R.with_translations(units, said).orderBy("block").collect()] == [(1, 0, 4, "First.", True), (1, 0, 5, "Second.", False)]

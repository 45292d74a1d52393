"""Lines, blocks, roles and regions of small pages, with what each rule should give."""
import random
from statistics import median

from lectern.operators import pages as P
from pyspark.sql import functions as F

PROSE = "Words of running text go on for a while here, and they say nothing at all, but in many lower case words"


def tokens(spark, rows):
    """rows: (page, text, x, baseline, font); each word is a token of half a font size a letter."""
    out = []
    for page, text, x, baseline, font in rows:
        for w in text.split():
            out.append((1, page, w, float(x), float(x + len(w) * font / 2), len(w) * font / 2, float(baseline - font), baseline + 0.12 * font, float(baseline), float(font)))
            x += (len(w) + 1) * font / 2
    random.Random(1).shuffle(out)
    return spark.createDataFrame(out, "doc long, page long, text string, x double, right double, width double, y double, bottom double, baseline double, font double")


def paragraph(page, x, top, n, font=10, words=8):
    w = PROSE.split()
    return [(page, " ".join(w[(i + j) % len(w)] for j in range(words)) + (" ends." if i == n - 1 else ""), x, top + 14 * i, font) for i in range(n)]


def test_baselines_follow_their_medians():
    rng = random.Random(2)
    for _ in range(200):
        ts = sorted((rng.uniform(0, 60), rng.choice([6.0, 10.0, 24.0])) for _ in range(25))
        made, want = [], []
        for at, font in ts:  # every baseline is asked, from the first
            n = next((i for i, b in enumerate(made) if abs(median([x for x, _ in b]) - at) <= max(2.5, max(median([f for _, f in b]), font) * 0.48)), len(made))
            if n == len(made):
                made.append([])
            made[n].append((at, font))
            want.append(n)
        assert P.baselines(ts, *P.BASELINE) == want


def test_lines(spark):
    rows = [(0, "left column text", 20, 100.5, 10), (0, "right column", 480, 100, 10), (0, "super", 105, 96.5, 7), (0, "12 . 5 %", 20, 130, 10), (0, "x", 20, 150, 10), (1, "other page", 20, 100, 10)]
    got = [(r["page"], r["line"], r["text"], r["cells"]) for r in P.lines(tokens(spark, rows), 900.0).orderBy("page", "line").collect()]
    assert got == [(0, 1, "left column text super", 4), (0, 2, "right column", 2), (1, 1, "other page", 2)]
    eol = tokens(spark, [(0, "one two", 20, 100, 10)]).withColumn("eol", F.col("text") == "one")
    assert [r["text"] for r in P.lines(eol, 900.0).orderBy("x").collect()] == ["one", "two"]
    assert P.lines(eol.limit(0), 900.0).count() == 0 and P.page_blocks(eol.limit(0), 900.0, 1200.0).count() == 0


def page_one():
    rows = [(0, "A study of large", 100, 80, 24), (0, "things in layers", 100, 108, 24), (0, "Ann Author and Ben Writer", 100, 140, 10)]
    rows += [(0, "1. Introduction", 40, 440, 12)] + paragraph(0, 40, 470, 6) + [(0, "Mobile Ions In", 40, 580, 11), (0, "Soft Matter", 40, 594, 11)] + paragraph(0, 40, 620, 5)
    rows += paragraph(0, 480, 440, 5) + [(0, "FIGURE 2", 480, 760, 9), (0, "(a) Curves of the samples and", 540, 760, 9), (0, "their fits in two panels.", 480, 771, 9)]
    rows += [(0, "Table 1. Values of cells", 480, 820, 9), (0, "sample   PCE   Voc", 480, 831, 9), (0, "A1   12.5   0.93   V", 480, 842, 9)]
    rows += [(0, "3 of 12", 400, 1180, 8), (0, "[12] A. Smith, B. Jones, J. Chem. 2001, 5.", 40, 760, 10)]
    return rows


def test_blocks_and_roles(spark):
    b = P.page_blocks(tokens(spark, page_one()), 900.0, 1200.0)
    found = b.collect()
    got = {r["text"]: r for r in found}
    role = {t[:24]: (r["role"], r["heading_level"]) for t, r in got.items()}
    assert role["A study of large things "] == ("heading", 1) and role["Ann Author and Ben Write"] == ("metadata", 0)
    assert role["1. Introduction"] == ("heading", 2) and role["Mobile Ions In Soft Matt"] == ("heading", 3)
    assert role["3 of 12"][0] == "artifact" and role["[12] A. Smith, B. Jones,"] == ("body", 0)
    figure = got["FIGURE 2 (a) Curves of the samples and their fits in two panels."]
    assert figure["role"] == "figure-caption" and figure["n_lines"] == 2 and figure["y"] == 751.0
    assert role["Table 1. Values of cells"] == ("figure-caption", 0) and any(t.startswith("sample PCE Voc A1") for t in got)
    body = [r for r in found if r["role"] == "body" and r["n_lines"] >= 5]
    assert len(body) == 3 and all(r["font"] == 10 and r["line_height"] == 14 for r in body)


def test_hyphens_indents_and_long_captions(spark):
    rows = [(0, "A word that is bro-", 40, 100, 10), (0, "ken goes on, and it", 40, 114, 10), (0, "ends here.", 40, 128, 10), (0, "Indented words begin anew", 60, 142, 10)]
    rows += [(1, "Figure 1. Head", 40, 100, 10)] + [(1, f"({'abcdefghijklmnopqrstuvwxyz'[i]}) part {'x' * (1 + i)}", 40, 100 + 24 * (i + 1), 10) for i in range(24)]
    got = {(r["page"], r["text"]): r["n_lines"] for r in P.page_blocks(tokens(spark, rows), 900.0, 1200.0).collect()}
    assert got[0, "A word that is broken goes on, and it ends here."] == 3 and got[0, "Indented words begin anew"] == 1
    assert sorted(n for (p, _), n in got.items() if p == 1)[-1] == P.MOST_MEMBERS


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, float(x), float(y), float(w), float(h), r, 10.0) for i, (t, x, y, w, h, r) in enumerate(rows)], "doc long, page long, block long, text string, x double, y double, width double, height double, role string, body double")


def test_regions(spark):
    rows = [
        (PROSE, 40, 100, 380, 100, "body"),
        ("axis label", 60, 300, 80, 12, "body"),
        ("Figure 1. A plot", 40, 420, 200, 12, "figure-caption"),
        (PROSE, 480, 100, 380, 600, "body"),
        ("Table 1. Values", 40, 500, 200, 12, "figure-caption"),
        ("a 1 2", 40, 530, 100, 12, "body"),
        ("b 3 4", 40, 550, 100, 12, "body"),
        (PROSE, 40, 620, 380, 100, "body"),
        ("3 of 9", 400, 1180, 40, 10, "artifact"),
    ]
    b = boxes(spark, rows)
    r = {x["kind"]: x for x in P.regions(b, 900.0, 1200.0).collect()}
    f, t = r["figure"], r["table"]
    # From 0.9 body sizes below the prose above to 0.35 above the caption; as wide as caption and labels with a margin.
    assert (f["y"], round(f["y"] + f["height"], 6), f["x"], f["x"] + f["width"]) == (209.0, 416.5, 32.0, 248.0) and f["members"] == [1] and f["caption"] == 2
    # From below the caption to 0.55 above the next prose.
    assert (t["y"], t["y"] + t["height"], t["members"]) == (513.5, 614.5, [5, 6]) and round(t["x"], 6) == 31.5 and t["x"] + t["width"] == 250.5
    done = {x["block"]: x["role"] for x in P.with_contents(b, P.regions(b, 900.0, 1200.0)).collect()}
    assert [done[i] for i in (1, 5, 6, 0, 2)] == ["figure-content"] * 3 + ["body", "figure-caption"]
    alone = boxes(spark, [("Figure 1. " + "wide words " * 5, 40, 900, 300, 12, "figure-caption")])
    w = P.regions(alone, 900.0, 1200.0).first()
    assert (round(w["x"], 6), round(w["x"] + w["width"], 6), w["y"]) == (32.0, 859.5, 48.0)
    assert P.regions(b.limit(0), 900.0, 1200.0).count() == 0 and P.regions(b.where("role = 'body'"), 900.0, 1200.0).count() == 0


def test_recognised_pages(spark):
    left = [(1, " ".join(PROSE.split()[:6]) + (" more" if i else "") + (" ends." if i == 4 else ""), 80, 400 + 30 * i, 500, 22) for i in range(5)]
    right = [(1, "Right column text that goes on" + (" here." if i == 3 else ""), 960, 400 + 30 * i, 480, 22) for i in range(4)]
    rows = [(1, "A wide title over both columns of this page, set large", 80, 100, 1500, 60), *right, *left, (1, " ", 80, 900, 100, 20), (1, "12 of 40", 700, 2340, 100, 20)]
    rows += [(2, "Late words", 80, 700, 300, 22), (2, "2. Results", 80, 1500, 300, 22), (2, "Under it", 80, 1700, 300, 22), (2, "Beside it", 960, 1400, 300, 22)]
    df = spark.createDataFrame([(7, p, t, float(x), float(y), float(w), float(h), 1800.0, 2400.0, 900.0, 1200.0) for p, t, x, y, w, h in rows], "doc long, page long, text string, x double, y double, width double, height double, image_width double, image_height double, page_width double, page_height double")
    token = P.recognised_tokens(df.where("text like 'A wide%'")).first()
    assert (token["x"], token["width"], round(token["font"], 9)) == (40.0, 750.0, 24.6) and abs(token["baseline"] - (50 + 30 - 24.6 * 0.12)) < 1e-9
    got = {(r["page"], r["id"]): r["source"][:12] for r in P.recognised_blocks(df, 900.0, 1200.0, first_page=2).collect()}
    assert [got[k] for k in sorted(got)] == ["A wide title", "Words of run", "Right column", "Late words", "Beside it", "2. Results", "Under it"]
    assert sorted(got)[0] == (1, "p001b001") and P.recognised_blocks(df.limit(0), 900.0, 1200.0).count() == 0

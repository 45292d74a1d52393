"""Saved translations for blocks against plain queues; analyses made safe."""
import random

from lectern.functions import formats as M
from lectern.operators import sessions as S
from pyspark.sql import functions as F


def test_three_tiers(spark):
    rng = random.Random(6)
    cur = [(d, p, b, rng.choice(["", "a", "b", "c", "d", "e", "f"])) for d in range(4) for p in range(4) for b in range(7)]
    old = [(d, p, b, rng.choice([t, t, "a", "b", "g"]), rng.choice(["T", "T", "T", "", None])) for d, p, b, t in cur if rng.random() < 0.8] + [(d, 5, b, "c", "late") for d in range(3) for b in range(3)]
    used, want = set(), {}
    items = {(d, p, b): (t, x) for d, p, b, t, x in old}
    for d, p, b, t in cur:
        if t and items.get((d, p, b), ("", ""))[0] == t and items[d, p, b][1]:
            want[d, p, b] = (p, b, 1)
            used.add((d, p, b))
    for tier in (2, 3):
        for d, p, b, t in cur:
            if t and (d, p, b) not in want:
                free = next((k for k in sorted(items) if k[0] == d and (tier == 3 or k[1] == p) and items[k][0] == t and items[k][1] and k not in used), None)
                if free:
                    want[d, p, b] = (free[1], free[2], tier)
                    used.add(free)
    got = S.cached_matches(spark.createDataFrame(cur, "doc long, page long, block long, text string"), spark.createDataFrame(old, "doc long, page long, block long, text string, translation string"))
    assert {(r["doc"], r["page"], r["block"]): (r["saved_page"], r["saved_block"], r["tier"]) for r in got.collect()} == want
    assert {x[2] for x in want.values()} == {1, 2, 3}


def test_analyses_made_safe(spark):
    chapters = [("90.7", " B ", "s" * 2000), ("-1", "no", ""), ("x", "no", ""), ("30", "A", None), ("1e9", "far", ""), ("30", " ", ""), (None, "no", ""), ("30", "A2", "")] + [("1", f"c{i}", "") for i in range(120)]
    df = spark.createDataFrame([(1, chapters, [("5", "q" * 4000)], ["3.9", "NaN", "500", None, "Infinity"], 100.0), (2, None, None, None, None), (3, chapters[:5], [], [], 0.0)], "id long, c array<struct<seconds:string,title:string,summary:string>>, q array<struct<seconds:string,quote:string>>, m array<string>, most double")
    got = {r["id"]: r for r in df.select("id", M.safe_chapters(F.col("c"), F.col("most")).alias("c"), M.safe_quotes(F.col("q"), F.col("most")).alias("q"), M.safe_moments(F.col("m"), F.col("most")).alias("m")).collect()}
    assert [(x["seconds"], x["at"], x["title"]) for x in got[1]["c"] if x["seconds"] > 1] == [(30, "0:30", "A"), (30, "0:30", "A2"), (90, "1:30", "B")] and len(got[1]["c"][-1]["summary"]) == 1500
    assert len(got[1]["c"]) == 92 + 3 and len(got[1]["q"][0]["quote"]) == 3000 and got[1]["m"] == [3]
    assert got[2]["c"] == got[2]["q"] == got[2]["m"] == [] and [x["title"] for x in got[3]["c"]] == ["A", "B", "far"]


def test_saved_blocks_are_met_in_one_shuffle(spark):
    rows = spark.range(500).select((F.col("id") % 5).alias("doc"), (F.col("id") / 100).cast("long").alias("page"), F.col("id").alias("block"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    met = S.cached_matches(rows, rows.withColumn("block", F.col("block") + 5).withColumn("translation", F.lit("T")))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert met.count() == 428 and not met.where("block % 7 = 0").count()

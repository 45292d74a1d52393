"""Pages: bands, reading order and copies on small pages; transcripts cut anew; strings that SQL does not state."""
from lectern.functions import split as P
from lectern.functions import web as W
from lectern.operators import layout as L
from lectern.operators import sessions as S
from lectern.operators import transcripts as T
from pyspark.sql import functions as F


def page(spark, rows):
    return spark.createDataFrame([(1, 0, i, float(x), float(y), float(w), 20.0, t) for i, (x, y, w, t) in enumerate(rows)], "doc long, page long, block long, x double, y double, width double, height double, text string")


def test_three_columns_are_read_in_turn(spark):
    rows = [(x, y, 200, f"{n}{y}") for y in (50, 100) for x, n in ((620, "right"), (20, "left"), (320, "middle"))] + [(20, 300, 820, "across"), (20, 400, 200, "below left"), (320, 390, 200, "below right")]
    b = page(spark, rows)
    bands = L.column_bands(b, 900.0).orderBy("band").collect()
    assert [r["centre"] for r in bands] == [120.0, 420.0, 720.0] and [r["blocks"] for r in bands] == [3, 3, 2]
    got = [rows[r["block"]][3] for r in L.in_reading_order(b, 900.0).orderBy("place").collect()]
    assert got == ["left50", "left100", "middle50", "middle100", "right50", "right100", "across", "below right", "below left"]
    ratios = L.column_ratios(b.select("doc", "page").distinct(), L.column_bands(b, 900.0)).first()
    assert (ratios["two"], ratios["three"]) == (1.0, 1.0)


def test_copies_regions_and_empty_pages(spark):
    long = "many words of a block that stand in another one, too " * 3
    b = page(spark, [(0, 0, 300, long + "and more"), (5, 5, 280, long), (0, 200, 300, "short"), (0, 200, 300, "short")])
    assert [r["block"] for r in L.without_overlapping_copies(b).orderBy("block").collect()] == [0, 2, 3]
    apart = page(spark, [(0, 0, 300, long + "and more"), (600, 500, 280, long)]).withColumn("lines", F.when(F.col("block") == 0, F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)])).otherwise(F.array(*[F.lit(float(x)) for x in (11, 21.1, 31.3)])))
    assert [r["block"] for r in L.without_overlapping_copies(apart).collect()] == [0]
    assert L.without_overlapping_copies(apart.withColumn("lines", F.transform("lines", lambda y: y * (F.col("block") + 1)))).count() == 2
    for f in (L.without_overlapping_copies, L.overlay_height, lambda x: L.column_bands(x, 900.0), lambda x: L.in_reading_order(x, 900.0)):
        assert f(b.limit(0)).count() == 0


def test_transcripts_cut_anew(spark):
    rows = [(1, i, s, 2.0, t) for i, (s, t) in enumerate([(0.0, "A first part, which goes on and on"), (2.0, "and ends here at last with a mark. Then"), (5.0, "a second sentence is said, and it"), (7.0, "ends as well after some more words here.")])]
    got = T.segments(spark.createDataFrame(rows, "k long, n long, start double, duration double, text string"), "k", "n", T.Limits(least=1)).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["A first part, which goes on and on and ends here at last with a mark.", "Then a second sentence is said, and it ends as well after some more words here."] and got[0]["start"] == 0.0 and 3 < got[1]["start"] < 4
    many = T.regroup([(0.0, 300.0, "word " * 900)])
    assert len(many) > 8 and all(len(x) <= 384 for _, x in many) and T.regroup([(0.0, 1.0, ""), (1.0, 1.0, "  ")]) == []


def test_chunks_and_thoughts():
    text = "One sentence is here. " * 60 + "x" * 1000
    c = P.chunks(text)
    assert all(len(x) <= 420 for x in c) and "".join(c).replace(" ", "") == text.replace(" ", "") and P.chunks("") == [""]
    assert P.thoughts("alpha beta, gamma delta; epsilon zeta eta", 30) == ["alpha beta, gamma delta;", "epsilon zeta eta"]


def test_reference_lists():
    assert len(P.references("1. Alpha one two 2. Beta three 3. Gamma four")) == 3 and P.references("1. Alpha 7. Beta 3. Gamma") == []
    assert len(P.references("References: [1] Smith, J. A title. [4] Jones, K. Another.")) == 2 and P.references("no marks") == P.references("") == []
    assert not P.reference_start("4. A General Plan for the Work") and P.reference_start("41. K") and P.reference_start("[2] Brown, T. Notes, 2001")
    assert P.references("1. Brown, T. Notes 2. Green, B. More")[1][:2] == (2, "Green, B. More")


def test_formulas():
    assert P.formula_runs("Fe2O3 in 5 cm-1") == [("Fe", ""), ("2", "sub"), ("O", ""), ("3", "sub"), (" in 5 cm", ""), ("-1", "sup")]
    assert P.formula_runs("H2 and Na+ and Xy3Z") == [("H2 and Na", ""), ("+", "sup"), (" and Xy3Z", "")]


def test_exports_and_addresses(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", "b"), (1, 1, 2.0, None, "c", ""), (2, 0, 0.0, None, "x", "y")], "k long, n long, start double, end double, source string, translation string")
    md = {r["k"]: r for r in S.markdown(rows.fillna(9.0, ["end"]), "k", "n").collect()}
    assert not md[1]["complete"] and md[1]["doc"].startswith("Translated: 1 / 2\n\n## 0001 00:00:00.000") and S.MISSING in md[1]["doc"]
    assert S.finished_only(S.srt(rows, "k", "n").where("k = 2")).first()["doc"] == "1\n00:00:00,000 --> 00:00:04,000\nx\ny"
    u = spark.createDataFrame([("https://a.b/t?pot=1&v=x&fmt=s&tlang=de#f",)], "u string")
    assert u.select(W.track_id(F.col("u"))).first()[0] == "https://a.b/t?v=x#f" and u.select(W.parameter(F.col("u"), "none")).first()[0] is None

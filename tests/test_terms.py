"""Dictionary terms against plain Python: boundaries, scripts, aliases, rival meanings, safe spans, dictionaries as files."""
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions.normal import normal_caption, normal_source, normal_target, normal_term
from lectern.operators import glossary as O
from lectern.operators import terms as J
from lectern.sources import glossary as G

DICT = "term_id long, source string, target string, domain string, aliases array<string>, requires_context boolean"


def plain(x):
    x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub("[-–—‑]", " ", x.replace("’", "'").lower())).strip()


def has(alias, text):
    return bool(plain(alias)) and re.search(r"(?<![a-z0-9])" + re.escape(plain(alias)) + r"(?![a-z0-9])", plain(text)) is not None


def test_matches_are_whole_in_any_script_and_of_any_length(spark):
    rng = random.Random(2)
    aliases = ["C++", "p-value", "one two three four", "量化", "café", "+x", "a", "A.B", "x y", "  ", "naïve-bayes model", "(q)", "é"]
    bits = ["plan c is fine", "c++", "C++11", "p. value", "p–value", "one two  three-four", "做量化研究", "CAFÉ", "1+x", "+x", "aa", "a", "a.b", "xx y", "x y", "naive bayes model", "(q)", "f(q)", "e"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for i in range(300)] + [(900, None), (901, "")]
    terms = spark.createDataFrame([(i, a, f"t{i}", None, [aliases[(i * 5 + 1) % len(aliases)]], False) for i, a in enumerate(aliases)], DICT)
    got = {(r["doc_id"], r["term_id"]): r["score"] for r in J.ranked(J.match_terms(spark.createDataFrame(docs, "doc_id long, text string"), terms), limit=100).collect()}
    want = {}
    for k, x in docs:
        for i, a in enumerate(aliases):
            found = [len(plain(y)) for y in (a, aliases[(i * 5 + 1) % len(aliases)]) if x and has(y, x)]
            if found:
                want[k, i] = max(found)
    assert got == want and len(want) > 300


def test_rival_meanings(spark):
    docs = spark.createDataFrame([(1, "CI pipeline and package manager"), (2, "ci alone"), (3, "the length of a bond, a coupon"), (4, "length only"), (5, "own word and bond")], "doc_id long, text string")
    rows = [(1, "ci", "integration", "programming", [], False), (2, "CI", "interval", "statistics", [], False), (3, "package manager", "pm", "programming", [], False), (4, "length", "maturity", "finance", [], True), (5, "coupon", "c", "finance", ["bond"], False), (6, "own word", "mine", None, [], False), (7, "own word", "theirs", "finance", [], False)]
    m = J.match_terms(docs, spark.createDataFrame(rows, DICT))
    got = {(r["doc_id"], r["target"]) for r in J.resolved(m).collect()}
    assert got == {(1, "integration"), (1, "pm"), (3, "maturity"), (3, "c"), (5, "c"), (5, "theirs")}
    asked = {(r["doc_id"], r["target"]) for r in J.resolved(m, requested="statistics").collect()}
    assert {(1, "interval"), (2, "interval")} <= asked and (1, "integration") not in asked
    assert (4, "maturity") in {(r["doc_id"], r["target"]) for r in J.resolved(m, requested="finance").collect()}
    own = {(r["doc_id"], r["target"]) for r in J.resolved(m, generic_wins=True).collect()}
    assert (5, "mine") in own and (5, "theirs") not in own


def test_protected_spans_leave_longer_concepts_alone(spark):
    rows = [(1, "confidence band", "b", "s", [], False), (2, "bootstrap confidence band", "x", "s", [], False), (3, "Bootstrap confidence band", "y", "m", [], False), (4, "one", "1", "s", [], False)]
    text = "A confidence band, a bootstrap confidence band; CONFIDENCE BAND " + "confidence band " * 5
    got = J.protected_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), spark.createDataFrame(rows, DICT)).orderBy("n").collect()
    want = [(m.start(), m.end()) for m in re.finditer("confidence band", text.lower()) if text.lower()[m.start() - 10 : m.start()] != "bootstrap "][:4]
    assert [(r["start"], r["end"]) for r in got] == want and [r["n"] for r in got] == [0, 1, 2, 3]


def test_dictionaries_as_texts_and_files(spark, tmp_path):
    rows = [(1, 'say "hi", you', "t,1", "d", ["a|b", "c"], True), (2, "plain", "x", None, [], False)]
    terms = spark.createDataFrame(rows, DICT).withColumn("note", F.lit("n"))
    csv_text, json_text = G.glossary_csv(terms).first()[0], G.glossary_json(terms).first()[0]
    texts = spark.createDataFrame([(1, csv_text), (2, json_text), (3, "a,b\r\nc,d,dom,,x|y,yes"), (4, None), (5, '[["p", "q"]]')], "k long, x string")
    got = {(r["k"], r["source"]): r for r in O.normalized_terms(G.parse_glossary_text(texts.where("k < 3"), "k", "x").withColumn("domain", F.concat_ws("", "domain", F.col("k").cast("string")))).collect()}
    for k in (1, 2):
        assert got[k, 'say "hi", you']["aliases"] == ["a|b", "c"] and got[k, 'say "hi", you']["requires_context"] and got[k, "plain"]["target"] == "x"
    more = {(r["k"], r["source"]): (r["target"], r["aliases"], r["requires_context"]) for r in G.parse_glossary_text(texts.where("k >= 3"), "k", "x").collect()}
    assert more == {(3, "a"): ("b", [], False), (3, "c"): ("d", ["x", "y"], True), (5, "p"): ("q", [], False)}
    for name, terms_ in (("academic", [{"source": "a", "target": "b"}]), ("finance", [{"source": "bond", "target": "c", "aliases": ["x"], "requiresContext": True}, {"source": "yield", "target": "d"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(terms_))
    assert [(r["domain"], r["source"]) for r in G.read_glossary(spark, str(tmp_path), "finance").orderBy("term_id").collect()] == [("finance", "bond"), ("finance", "yield")]
    assert [r["source"] for r in G.read_glossary(spark, str(tmp_path), "none").collect()] == ["a"] and G.read_all(spark, str(tmp_path)).count() == 3
    (tmp_path / "twice.json").write_text(json.dumps([{"source": "X", "target": "1"}, {"source": "x ", "target": "2"}]))
    with pytest.raises(ValueError, match="twice:x"):
        G.read_all(spark, str(tmp_path))


def test_merges_gates_and_caps(spark):
    saved = spark.createDataFrame([(1, "Own", "o", None, [], False), (2, "term", "edited", "d", [], False)], DICT)
    preset = spark.createDataFrame([(10, "own", "p", "d", [], False), (11, "term", "p", "d", ["al"], True), (12, "term", "q", "e", [], False), (13, "new", "r", None, [], False)], DICT)
    assert {r["term_id"] for r in O.merge_missing(saved, preset).collect()} == {1, 2, 12, 13}
    once, done = O.migrated(saved.unionByName(spark.createDataFrame([(3, "New", "r", None, None, None)], DICT)), preset, [], "v2")
    assert done == ["v2"] and {r["term_id"]: r["aliases"] for r in once.collect()}[3] == [] and O.migrated(once, preset, done, "v2")[0] is once
    assert {r["term_id"] for r in O.retired(saved, spark.createDataFrame([("OWN", "o"), ("term", "p")], "source string, target string")).collect()} == {2}
    assert O.capped(saved, 2).count() == 2
    with pytest.raises(Exception, match="over 1 rows"):
        O.capped(saved, 1).collect()
    cases = spark.createDataFrame([(1, ["a", "b"], ["c"]), (2, ["a"], [])], "case_id long, expected array<string>, forbidden array<string>")
    found = spark.createDataFrame([(1, "a"), (1, "c")], "case_id long, target string")
    assert {r["case_id"]: (r["expected"], r["forbidden"]) for r in O.check_cases(found, cases).collect()} == {1: (["b"], ["c"]), 2: (["a"], [])}


def test_normal_forms(spark):
    x = "  Ünïted—ﬁrst’s x­​y  量 化 ， 好 !"
    got = spark.createDataFrame([(x,), (None,), ("",)], "x string").select(*[f(F.col("x")).alias(str(i)) for i, f in enumerate((normal_term, normal_target, normal_source, normal_caption))]).collect()
    assert got[0]["0"] == plain(x) and got[1]["0"] is None and got[2]["1"] == ""
    assert got[0]["1"] == re.sub(r"[\s\-–—·•‐‑‒'’]+", "", unicodedata.normalize("NFKC", x).casefold())
    assert got[0]["2"].startswith("Ünïted—first’s xy") and got[0]["3"].endswith("量化，好!")


def test_matches_by_automaton_and_by_joins(spark, monkeypatch):
    words = ["a", "ab", "c++", "@", "p-value", "long run of words", "run", "été", "中文", "x_y", "words"]
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice([*words, "zz", "abab", "(ab)", "1a", "run-of", "Long Run of  words", "@@", "中文字", "x_y_z"]) for _ in range(rng.randrange(12)))) for i in range(80)] + [(80, None), (81, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame([(i, w, f"t{i}", None, [w.upper()], False) for i, w in enumerate(words)], DICT)
    names = g.select(F.col("source").alias("alias"))
    got = []
    for most in (50_000, 0):
        monkeypatch.setattr(J, "BROADCAST_SPELLINGS", most)
        got.append([sorted(map(str, f.collect())) for f in (J.match_terms(d, g).select("doc_id", "term_id", "alias", "score"), J.term_spans(d, names, "doc_id", "text"), J.contained(d, names))])
    assert got[0] == got[1] and all(len(x) > 50 for x in got[0])
    spans = {(r["doc_id"], r["alias"], r["start"], r["end"]) for r in J.term_spans(d, names, "doc_id", "text").collect()}
    assert spans == {(i, w, m.start(), m.end()) for i, t in docs if t for w in words for m in re.finditer(r"(?<![A-Za-z0-9_])" + re.escape(w) + r"(?![A-Za-z0-9_])", t.lower())}


def test_markers_go_there_and_back(spark):
    terms = spark.createDataFrame([(1, "neural network", "神经网络", "ml", [], False), (2, "deep neural network", "深度网络", "ml", ["deep neural networks"], True), (3, "loss value", "损失值", "ml", [], False)], DICT)
    rows = [(1, "A neural network has a loss value of 5 % and neural network is NN"), (2, "deep neural network only"), (3, "nothing 12 here"), (4, None), (5, "neural network, neural network, neural network, neural network, neural network")]
    m = {r["doc_id"]: r for r in J.with_markers(spark.createDataFrame(rows, "doc_id long, text string"), terms).collect()}
    assert m[1]["marked"] == "A ⟪QS_PROTECTED_2⟫ has a ⟪QS_PROTECTED_3⟫ of ⟪QS_PROTECTED_0⟫ and ⟪QS_PROTECTED_4⟫ is ⟪QS_PROTECTED_1⟫"
    assert m[1]["values"] == ["5 %", "NN", "神经网络", "损失值", "神经网络"] and m[1]["literals"] == 2
    assert m[2]["values"] == [] and m[3]["values"] == ["12"] and m[4]["marked"] == "" and m[5]["marked"].endswith("⟪QS_PROTECTED_3⟫, neural network")
    cases = [("QS_PROTECTED_2 ⟪QS_PROTECTED_3⟫⟪QS_PROTECTED_4⟫", True), ("⟪QS_PROTECTED_2⟫⟪QS_PROTECTED_3⟫", False), ("⟪QS_PROTECTED_2⟫⟪QS_PROTECTED_2⟫⟪QS_PROTECTED_3⟫⟪QS_PROTECTED_4⟫", False), ("⟪QS_PROTECTED_2⟫⟪QS_PROTECTED_3⟫⟪QS_PROTECTED_4⟫⟪QS_PROTECTED_5⟫", False), ("⟪QS_PROTECTED_99999999999⟫⟪QS_PROTECTED_2⟫⟪QS_PROTECTED_3⟫⟪QS_PROTECTED_4⟫", False)]
    got = spark.createDataFrame(cases, "a string, want boolean").select("want", J.markers_kept(F.col("a"), F.array(*[F.lit("v")] * 5), F.lit(2)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_models_that_damage_markers(spark):
    from lectern.operators import providers

    terms = spark.createDataFrame([(1, "neural network", "神经网络", "ml", [], False)], DICT)
    rows = [(i, f"the neural network {i}" if i % 2 else f"plain text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keeps = lambda texts, a, b: [f"说 {t}" for t in texts]
    breaks = lambda texts, a, b: [f"说 {t}".replace("⟪QS_PROTECTED_1⟫", "") for t in texts]
    some = lambda texts, a, b: [f"说 {t}".replace("⟪QS_PROTECTED_1⟫", "") if "the" in t and len(t) % 2 else f"说 {t}" for t in texts]
    run = lambda p, n: {r["doc_id"]: (r["translation"], r["way"], r["error"]) for r in providers.translate_with_terms(df, terms, "doc_id", "text", "en", "zh", p, n).collect()}
    got = run(keeps, 5)
    assert len(got) == 40 and got[1] == ("说 the 神经网络 1", "terms", None) and got[2] == ("说 plain text 2", "literals", None)
    got = run(breaks, 5)
    ways = [w for _, w, _ in got.values()]
    assert ways.count("plain") == 5 and ways.count("bypassed") == 15 and all(t == f"说 {rows[i][1]}" and e is None for i, (t, _, e) in got.items())
    calls = run(some, 0)
    assert all(t.startswith("说 ") for t, *_ in calls.values()) and {w for _, w, _ in calls.values()} <= {"terms", "plain", "literals"}
    assert run(lambda texts, a, b: ["说"] * len(texts), 3)[2][2] == "literal lost"


def test_marked_texts_are_not_shuffled(spark, monkeypatch):
    words = ["bond yield", "yield curve", "long bond yield", "e-mail list", "list of", "x y"]
    terms = spark.createDataFrame([(i, w, f"t{i}", "m", [], w == "long bond yield") for i, w in enumerate(words)], DICT)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice([*words, "bond", "Yield", "long", "12 %", "x  y", "list", "İ"]) for _ in range(rng.randrange(14)))) for i in range(120)] + [(120, None), (121, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert "Exchange" not in J.with_markers(docs, terms)._jdf.queryExecution().executedPlan().toString()
    got = []
    for most in (50_000, 0):
        monkeypatch.setattr(J, "BROADCAST_SPELLINGS", most)
        got.append([sorted(map(str, f.collect())) for f in (J.protected_spans(docs, terms).select("doc_id", "n", "start", "end", "alias", "target"), J.with_markers(docs, terms))])
    assert got[0] == got[1] and len(got[0][0]) > 100


def test_captions_in_two_passes_over_the_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["中", "文", " ", " ", "，", ".", "a", "!", "：", "\n", "　", " "]) for _ in range(rng.randrange(16))) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", normal_caption(F.col("x")).alias("y"))
    steps = ((r"\s+", " "), ("([㐀-鿿]) ([㐀-鿿])", r"\1\2"), ("([，。；：！？]) (?=[㐀-鿿])", r"\1"), (" ([,.;:!?，。；：！？])", r"\1"))
    for r in df.collect():
        want = r["x"]
        for a, b in steps:
            want = re.sub(a, b, want)
        assert r["y"] == want.strip(" "), r["x"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2

"""The licence classifier: held-out wordings, line by line against the plain form, odd rows."""
import random

from lectern.llm import licences as L


def lines(n=300):
    rng = random.Random(5)
    return [" ".join(rng.choice(["stone", "river", "the", "of", "light", "software", "use", "any", "is", "free"]) + str(rng.randrange(3) or "") for _ in range(rng.randint(5, 15))) for _ in range(n)]


def test_held_out_wordings_and_plain_lines():
    m = L.LicenceModel(lines())
    for family, texts in L.TEMPLATES.items():
        assert all(m.classify(t)[0] == family for t in texts), family
    right = [m.classify(t)[0] == family for family, texts in L.HELD_OUT.items() for t in texts]
    assert sum(right) >= 0.7 * len(right)
    fresh = lines(600)[300:]
    assert sum(m.classify(x)[0] == L.NONE for x in fresh) >= 0.99 * len(fresh)
    assert m.classify("He has a licence to fish in this river, and no permission for more.")[0] == "unknown"


def test_texts_line_by_line(spark):
    plain = lines()
    m = L.LicenceModel(plain)
    rng = random.Random(6)
    notices = [t for ts in (*L.TEMPLATES.values(), *L.HELD_OUT.values()) for t in ts] + ["a licence", "(c) copyright", "", "  ", "MIT", "É permission"]
    for _ in range(60):
        text = "\n".join(rng.choice(plain + notices * 3) for _ in range(rng.randint(1, 30)))
        want = [(i, f, round(p, 5)) for i, (f, p) in enumerate(map(m.classify, text.split("\n"))) if f != L.NONE]
        assert [(i, f, round(p, 5)) for i, f, p in m.scan(text)] == want
    assert m.scan(None) == m.scan("") == []
    notice = "Released under the MIT License."
    rows = [(1, notice, 0), (1, notice, 0), (None, "x\n" + notice, 1), (2, None, 2), (3, "word " * 200_000 + "\n" + notice, 3)] + [(10 + i, x, 4) for i, x in enumerate(plain)]
    got = L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, found int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert sum(r["doc_id"] == 1 and r["families"] == "mit" for r in got) == 2 and by[None]["found"].startswith("1:mit") and by[3]["families"] == "mit" and by[2]["n_paragraphs"] == 0

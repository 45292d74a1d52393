"""Catalogue queries do their whole job: against brute force on fixtures with long, repeated and many-lined texts."""
import random
import re
from collections import Counter, defaultdict

from lectern.plans.catalogue import QUERIES


def run(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]


def test_dice_of_all_pairs_over_the_threshold(spark, tmp_path):
    rng = random.Random(4)
    line = lambda i: f"line {i} ".ljust(10 + i % 40, "x")
    docs = []
    for k in range(60):
        base = [line(rng.randrange(12) + 100 * (k % 5)) for _ in range(8)]
        docs += [(10 * k + j, "\n".join(base[: rng.randint(5, 8)] + ["", line(7)] * rng.randrange(3))) for j in range(4)]
    docs += [(9000, None), (9001, ""), (9002, docs[0][1]), (9003, docs[0][1])]
    got = {(a, b): x for a, b, x in run(spark, tmp_path, "bag_dice_similarity", "documents", docs, "doc_id long, text string")}
    bags = {k: Counter(x for x in (t or "").split("\n") if x) for k, t in docs}
    first = {}
    for k, b in bags.items():
        first.setdefault(frozenset(b.items()), k)
    size = {k: sum(n * len(x) for x, n in b.items()) for k, b in bags.items()}
    reps, want = set(first.values()), {}
    for a in bags:
        rep = first[frozenset(bags[a].items())]
        if rep != a and bags[a]:
            want[rep, a] = 1.0
        for b in bags:
            common = sum(n * len(x) for x, n in (bags[a] & bags[b]).items())
            if a < b and {a, b} <= reps and common and 200 * common >= 72 * (size[a] + size[b]):
                want[a, b] = round(2 * common / (size[a] + size[b]), 6)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want) and len(want) > 100


def test_sentences_of_texts_of_any_length(spark, tmp_path):
    docs = [(0, "One. Two! Three?", 16), (1, "A long one. " * 400, 4800), (2, "No length. Known", None), (3, None, None), (4, "", 0)]
    got = sorted(run(spark, tmp_path, "sentence_split_offsets", "documents", docs, "doc_id long, text string, n_chars long"))
    assert got == [(k, i, m.start(), len(m[0])) for k, t, _ in docs for i, m in enumerate(re.finditer(r"[^.!?]+[.!?]*", t or ""))]


TURNS = [(1, 0, "user", "one line"), (1, 1, "user", "\n \nfirst <b>line</b>\r\nsecond\tline\n\n\nthird"), (1, 150, "user", "late\nturn"), (2, 13000, "user", "much\nlater"), (2, 1, "user", " \n\t"), (2, 2, "user", None)]


def test_cues_of_all_lines_and_turns(spark, tmp_path):
    got = sorted(run(spark, tmp_path, "captions_parse", "conversations", TURNS, "conv_id long, turn int, role string, text string"))
    want = [(c, i, 30.0 * i, 30.0 * i + 2.5, " ".join(re.sub("<[^>]*>", "", t).split())) for c, i, _, t in TURNS if t and t.split()]
    assert got == sorted(want) and (1, 1, 30.0, 32.5, "first line second line third") in got


def test_fragments_of_all_words_merge(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 9, 10, 11, 15, 16, 17, 22, 23, 500)] + ["", None]
    # Where a text repeats itself, the longest overlap can be longer than the true one; only such texts don't come back whole.
    texts += ["same " * 30, " ".join(f"w{i}" for i in range(60)) + " end" * 20]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]

    def merged(w):
        left = []
        for f in [w[i * 6 : i * 6 + 10] for i in range(max(-(-(len(w) - 10) // 6), 0) + 1)]:
            n = next(n for n in range(min(len(left), len(f), 12), -1, -1) if n == 0 or left[-n:] == f[:n])
            left = left + f[n:]
        return left == w

    got = {i: x for _, i, x in run(spark, tmp_path, "stream_overlap_merge", "conversations", rows, "conv_id long, turn int, role string, text string")}
    assert got == {i: merged((t or "").split() or [""]) for i, t in enumerate(texts)} and [got[i] for i in range(12)] == [True] * 12 and not got[13]


LONG = [(k, "\n".join("" if i % 7 == 3 else "x" * ((i * 37 + k) % 420) for i in range(n))) for k, n in enumerate([1, 59, 60, 61, 130, 400])]


def boxes(text):
    for i, x in enumerate(text.split("\n")):
        if x:
            yield i, i // 60, i % 2 * 450 + 20, i % 60 // 2 * 20, 250 + len(x) % 400


def test_blocks_of_all_lines_are_ordered(spark, tmp_path):
    got = run(spark, tmp_path, "reading_order", "documents", LONG, "doc_id long, text string")
    want = [(k, b[0], i + 1) for k, t in LONG for i, b in enumerate(sorted(boxes(t), key=lambda b: (b[1], b[2] + b[4] / 2 >= 450, b[3], b[2], b[0])))]
    assert sorted(got) == sorted(want) and len([x for x in want if x[0] == 5]) > 300


def test_overlaps_are_counted_on_every_page(spark, tmp_path):
    got = run(spark, tmp_path, "overlapping_blocks", "documents", LONG, "doc_id long, text string")
    want = defaultdict(list)
    for k, t in LONG:
        b = list(boxes(t))
        for x in b:
            for y in b:
                if x[0] < y[0] and (x[1], x[3]) == (y[1], y[3]) and (width := min(x[2] + x[4], y[2] + y[4]) - max(x[2], y[2])) > 0:
                    want[k].append(width)
    assert {k: (n, w) for k, n, w in got} == {k: (len(v), sum(v)) for k, v in want.items()} and len(want[5]) > 20

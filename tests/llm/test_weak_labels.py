"""The quality classifier against plain Python: votes, expectation-maximisation by hand, the scorer's gradient, odd rows."""
import math
import random
import re

import numpy as np

from lectern.llm import weak_labels as W
from lectern.llm.common import smallest_by_hash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_votes(text):
    """The nine labellers as the module states them, on one ASCII text."""
    text = text or ""
    w = WORDS.findall(text)
    if len(w) < 20:
        return [2] * W.LABELLERS
    size = sum(map(len, w))
    count = lambda cs: sum(c in cs for c in text)
    symbols, upper, digits = count("#*$%&|<>") / size, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, count("0123456789") / size
    marks, length = count("!?") / len(w), size / len(w)
    distinct, pairs = len(set(w)) / min(len(w), 1000), len(set(zip(w, w[1:]))) / min(len(w), 3000)
    own = [x for x in text.split("\n") if x.strip()]
    lines = 1 - len(set(own)) / len(own) if "\n" in text else 0
    pick = lambda bad, good: 0 if bad else 1 if good else 2
    return [
        pick(symbols > 0.04, symbols < 0.005), pick(upper > 0.25, upper < 0.06), pick(marks > 0.5, marks < 0.05), pick(digits > 0.2, digits < 0.05), pick(distinct < 0.12, distinct > 0.35),
        pick(lines > 0.4, lines < 0.1), pick(length < 3 or length > 12, 4 < length < 8), pick(symbols > 0.02 or marks > 0.3 or upper > 0.3, symbols == 0 and marks == 0), pick(pairs < 0.25 or lines > 0.3, pairs > 0.5),
    ]


def texts(n=120):
    rng = random.Random(8)
    good = [f"word{i % 60}x" for i in range(200)]
    out = [None, "", "one two", "short text again"]
    for i in range(n):
        w = [rng.choice(good) for _ in range(rng.randint(15, 120))]
        kind = i % 6
        if kind == 1:
            w = ["BUY", "NOW!!", "$$$", *w[:20]] * 3
        elif kind == 2:
            w = w[:4] * 30
        elif kind == 3:
            w = [x + "\n" for x in w[:5]] * 12
        elif kind == 4:
            w = [str(rng.randrange(10**6)) for _ in w]
        out.append(" ".join(w))
    return out


def plain_em(votes, rounds):
    post = [0.1 if 0 in v else 0.9 if 1 in v else 0.5 for v in votes]
    for _ in range(rounds):
        share = (sum(post) + 1) / (len(votes) + 2)
        chance = {}
        for k in range(W.LABELLERS):
            for c in (0, 1):
                cast = [sum((p if c else 1 - p) for v, p in zip(votes, post) if v[k] == x) + 1 for x in (0, 1)]
                chance[k, c] = [x / sum(cast) for x in cast]
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[k, 1][x] / chance[k, 0][x]) for k, x in enumerate(v) if x < 2)
            new.append(1 / (1 + math.exp(-odds)))
        if max(abs(a - b) for a, b in zip(post, new)) < 1e-9:
            break
        post = new
    return post


def test_votes_are_the_stated_rules():
    t = texts()
    assert W.Batch(t).votes().tolist() == [plain_votes(x) for x in t]


def test_em_by_hand():
    votes = [plain_votes(x) for x in texts()]
    codes = [sum(x * 3**k for k, x in enumerate(v)) for v in votes]
    patterns, counts = np.unique(codes, return_counts=True)
    for rounds in (1, 2, 200):
        share, table, post = W.em(patterns, counts.astype(float), rounds)
        want = dict(zip(codes, plain_em(votes, rounds)))
        assert all(abs(want[c] - p) < 1e-9 for c, p in zip(patterns.tolist(), post.tolist()))
    assert 0 < share < 1 and (table[:, :, :2] > 0).all()


def test_scorer_lowers_its_loss_and_separates():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(200), 5)
    target = (np.arange(200) % 3 > 0).astype(float) * 0.9 + 0.05
    feature = np.where(rng.random(1000) < 0.8, np.where(target[doc] > 0.5, rng.integers(0, 50, 1000), rng.integers(50, 100, 1000)), rng.integers(100, 150, 1000))
    w, bias = W.train(doc, feature, np.ones(1000), target)
    p = 1 / (1 + np.exp(-(np.bincount(doc, weights=w[feature]) + bias)))
    assert ((p > 0.5) == (target > 0.5)).all() and abs(w[200:]).max() == 0


def test_query_on_odd_rows(spark):
    t = texts()
    rows = [(i, x, "c", 1) for i, x in enumerate(t)] + [(5, t[5], "c", 1), (None, t[6], None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, score int")
    got = W.quality_classifier(df).collect()
    assert len(got) == len(rows)
    want = plain_em([plain_votes(x) for _, x, *_ in rows], W.EM_ROUNDS)
    by_text = {x: p for (_, x, *_), p in zip(rows, want)}
    for r in got:
        if r["doc_id"] is not None:
            assert abs(r["posterior"] - by_text[t[r["doc_id"]]]) < 1e-6 and r["n_votes"] == sum(v < 2 for v in plain_votes(t[r["doc_id"]]))
    twice = [r for r in got if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got)
    assert W.quality_classifier(df.limit(0)).count() == 0


def test_sample_of_repeated_ids_is_the_same_in_any_partitioning(spark):
    rows = [(None, f"text {i % 900}") for i in range(3000)] + [(i, f"own {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string")
    for n in (10, 400):
        got = [sorted(r["text"] for r in smallest_by_hash(df.repartition(k), "id", n).collect()) for k in (1, 3, 7)]
        assert got[0] == got[1] == got[2] and n / 3 <= len(got[0]) <= 2 * n
    assert smallest_by_hash(df.limit(0), "id", 5).count() == 0

"""Quality classifier from weak labels: overlapping heuristic labellers, their accuracies by EM, and a hashed linear scorer.

1. Each labeller votes good, bad or abstains on every document. Votes of all documents are counted by pattern; their
   number is bounded by 3 ** labellers, whatever the corpus.
2. Expectation-maximisation on the pattern counts estimates the share of good documents and each labeller's chance of
   each cast vote in either class, and so the posterior of every pattern.
3. A bounded sample of documents (TRAIN_ROWS) with these posteriors as soft labels trains a logistic scorer on hashed
   word and word-shape shares and on buckets of document measures.
4. Every document is scored over its whole text.

A document is kept if its score is at least `threshold`. Short documents carry little evidence and get scores near their
prior; the labellers abstain on them.

Defined results: a null or empty text gets no votes and the scorer's prior for it; equal texts get equal scores; other
columns are ignored; an empty table gives an empty table and trains nothing.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import flat, prefix_sums, spans_hash, words
from lectern.llm.common import smallest_by_hash

#: Hashed features, rows of the training sample, rounds of EM and of training.
DIM = 1 << 15
TRAIN_ROWS = 3000
EM_ROUNDS, TRAIN_ROUNDS = 200, 150
#: Characters per numpy batch.
BATCH = 1 << 20
MEASURES = 8
BINS = 12

_UPPER, _DIGIT, _SYMBOL, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK[[ord(c) for c in "!?"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("X"), ord("x"), ord("9"), ord("x")


class Batch:
    """Word hashes and measures of a batch of texts."""

    def __init__(self, texts: list[str | None]):
        b, ends = flat(texts)
        self.n_docs = len(texts)
        start, end, first = words(b, ends)
        self.n = np.diff(first)
        self.owner = np.repeat(np.arange(self.n_docs), self.n)
        self.word = spans_hash(prefix_sums(b), start, end)
        # Shapes: character classes with repetitions within a word collapsed.
        shape = _SHAPE[b]
        inside = np.ones(len(b), bool)
        inside[1:] = shape[1:] != shape[:-1]
        if len(start):
            inside[start] = True
        place = np.concatenate(([0], np.cumsum(inside)))
        self.shape = spans_hash(prefix_sums(shape[inside]), place[start], place[end])
        per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[ends])
        size = np.maximum(np.bincount(self.owner, weights=end - start, minlength=self.n_docs), 1)
        distinct = self._distinct(self.word, self.owner)
        pair = self.word[:-1] * np.uint64(3) + self.word[1:]
        inside = self.owner[:-1] == self.owner[1:]
        pairs = self._distinct(pair[inside], self.owner[:-1][inside])
        lines = self._lines(texts)
        n = np.maximum(self.n, 1)
        self.measures = np.stack([per(_SYMBOL[b]) / size, per(_UPPER[b]) / size, per(_MARK[b]) / n, per(_DIGIT[b]) / size, distinct / np.minimum(n, 1000), lines, size / n, pairs / np.minimum(n, 3000)], axis=1)

    def _distinct(self, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many distinct hashes each document has."""
        order = np.lexsort((h, owner))
        h, o = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=self.n_docs)

    @staticmethod
    def _lines(texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t and "\n" in t:
                own = [x for x in t.split("\n") if x.strip()]
                out[i] = 1 - len(set(own)) / len(own) if own else 0
        return out

    def votes(self) -> np.ndarray:
        """(documents, labellers): 1 good, 0 bad, 2 abstains. All abstain on fewer than 20 words."""
        symbols, upper, marks, digits, distinct, lines, length, pairs = self.measures.T
        pick = lambda bad, good: np.where(bad, 0, np.where(good, 1, 2))
        v = np.stack(
            [
                pick(symbols > 0.04, symbols < 0.005),
                pick(upper > 0.25, upper < 0.06),
                pick(marks > 0.5, marks < 0.05),
                pick(digits > 0.2, digits < 0.05),
                pick(distinct < 0.12, distinct > 0.35),
                pick(lines > 0.4, lines < 0.1),
                pick((length < 3) | (length > 12), (length > 4) & (length < 8)),
                pick((symbols > 0.02) | (marks > 0.3) | (upper > 0.3), (symbols == 0) & (marks == 0)),
                pick((pairs < 0.25) | (lines > 0.3), pairs > 0.5),
            ],
            axis=1,
        )
        v[self.n < 20] = 2
        return v

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) triples: shares of hashed words and shapes, and one bucket per measure."""
        share = 1 / np.maximum(self.n, 1)[self.owner]
        half = np.uint64(DIM // 2)
        edges = [(0.005, 0.5), (0.01, 0.8), (0.02, 3), (0.01, 0.6), (0.01, 1), (0.02, 1), (1, 30), (0.01, 1)]
        bins = np.stack([np.digitize(self.measures[:, j], np.geomspace(lo, hi, BINS - 1)) for j, (lo, hi) in enumerate(edges)], axis=1)
        bins[self.n < 20] = BINS - 1  # too short for measures: a bucket of their own, shared with the extreme
        docs = np.arange(self.n_docs)
        f = [(self.word % half).astype(np.int64), (self.shape % half).astype(np.int64) + DIM // 2, *[DIM + j * BINS + bins[:, j] for j in range(MEASURES)]]
        return np.concatenate([self.owner, self.owner, *[docs] * MEASURES]), np.concatenate(f), np.concatenate([share, 4 * share, *[np.full(self.n_docs, 1.0)] * MEASURES])


LABELLERS = 9
_POWERS = 3 ** np.arange(LABELLERS)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, table [labeller, class, vote], posterior of each pattern) from counted vote patterns. The table has
    the chances of votes that are cast; abstentions say nothing about the class.

    Begins with good only where no labeller says bad, as each is right more often when it says so; a small prior keeps chances away from 0 and 1."""
    votes = patterns[:, None] // _POWERS % 3
    good, bad = (votes == 1).any(1), (votes == 0).any(1)
    post = np.where(bad, 0.1, np.where(good, 0.9, 0.5))
    share, table = 0.5, np.zeros((LABELLERS, 2, 3))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - post), counts * post])
        share = (mass[1].sum() + 1) / (counts.sum() + 2)
        for v in range(2):
            table[:, :, v] = np.einsum("cp,pl->lc", mass, votes == v) + 1
        table[:, :, :2] /= table[:, :, :2].sum(axis=2, keepdims=True)
        table[:, :, 2] = 1  # an abstention says nothing
        log = np.log(table)[np.arange(LABELLERS)[None, :], :, votes].sum(axis=1) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, table, post


def _batches(pdf: pd.DataFrame, key: str, text: str) -> Iterator[tuple[pd.Series, list]]:
    start = held = 0
    texts = [t if isinstance(t, str) else None for t in pdf[text]]
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > BATCH or i == len(texts) - 1:
            yield pdf[key].iloc[start : i + 1], texts[start : i + 1]
            start, held = i + 1, 0


def train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = TRAIN_ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets, classes balanced, by Adam on the whole sample; a little L2."""
    size = DIM + MEASURES * BINS
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[feature] * value, minlength=len(target)) + bias, -30, 30)))
        g = weight * (p - target)
        grad = np.bincount(feature, weights=g[doc] * value, minlength=size) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        step = lambda a, b, i=i: 0.05 * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)
        w, bias = w - step(m, v), bias - step(mb, vb)
    return w, bias


def quality_classifier(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, n_votes, posterior, score, kept) of every document; see the module's text."""
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema[0].dataType.simpleString()

    def vote(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for pdf in pdfs:
            for _, texts in _batches(pdf, "id", "text"):
                for p, c in zip(*np.unique(Batch(texts).votes() @ _POWERS, return_counts=True), strict=True):
                    counts[int(p)] = counts.get(int(p), 0) + int(c)
        yield pd.DataFrame({"pattern": list(counts), "n": list(counts.values())}, dtype="int64")

    rows = own.mapInPandas(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    table = np.full(3**LABELLERS, 0.5)
    w, bias = np.zeros(DIM + MEASURES * BINS), 0.0
    if len(rows):
        table[patterns] = em(patterns, counts)[2]

        def sample(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for ids, texts in _batches(pdf, "id", "text"):
                    b = Batch(texts)
                    d, f, v = b.features()
                    order = np.argsort(d, kind="stable")
                    cut = np.searchsorted(d[order], np.arange(len(ids) + 1))
                    f, v = f[order].astype(np.int32), v[order].astype(np.float32)
                    pairs = list(zip(cut[:-1], cut[1:], strict=True))
                    yield pd.DataFrame({"p": table[b.votes() @ _POWERS], "f": [f[a:z].tobytes() for a, z in pairs], "v": [v[a:z].tobytes() for a, z in pairs]})

        # A bounded sample; train_rows is its documented size.
        some = smallest_by_hash(own.where("text is not null"), "id", train_rows)
        got = some.mapInPandas(sample, "p double, f binary, v binary").collect()
        if got:
            f, v = [np.frombuffer(r["f"], np.int32) for r in got], [np.frombuffer(r["v"], np.float32) for r in got]
            w, bias = train(np.repeat(np.arange(len(got)), [len(x) for x in f]), np.concatenate(f), np.concatenate(v), np.array([r["p"] for r in got]))
    weights = w.astype(np.float32)  # 130 kB

    def score(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for ids, texts in _batches(pdf, "id", "text"):
                b = Batch(texts)
                d, f, v = b.features()
                votes = b.votes()
                s = 1 / (1 + np.exp(-np.clip(np.bincount(d, weights=weights[f] * v, minlength=len(texts)) + bias, -30, 30)))
                yield pd.DataFrame({"id": ids, "n_votes": (votes < 2).sum(1), "posterior": table[votes @ _POWERS], "score": s, "kept": s >= threshold})

    return own.mapInPandas(score, f"id {kind}, n_votes long, posterior double, score double, kept boolean").withColumnRenamed("id", key)

"""Hard negatives by product quantisation: bounds from stored residual norms choose what is scored exactly.

Vectors become integers. A codebook for each few dimensions, fitted on a bounded sample, gives every vector its codes; what
the codes leave out, the residual, is stored by its norms over GROUPS of dimensions. A table of an anchor's products with
all codewords gives its score with a coded vector as a sum of looked-up numbers, and by Cauchy and Schwarz the exact score
lies within the products of anchor norms and residual norms around it. Whatever these bounds can't exclude is scored
exactly in integers; so codebooks decide how much is scored, never what is found.

Two passes, each exact. The first finds each anchor's best rows of its own label, its positives. Their scores set windows
(`low` to `high` percent of a positive's score), and the second pass completes each window: its best rows of other labels.
Rows are packed into blobs by Arrow batch, dealt to chunks; anchors are dealt to stripes; a task gets one chunk and one
stripe, and returns no more than a few rows for each anchor, so tasks are of bounded size, and no label, however common, is
a key. Rows and anchors never pass through the driver; it sees the sample, counts and the codebooks (64 kB for 64 dimensions).

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a null id is never
an anchor's, and comes last among equal scores; "other" rows are those of other ids, so repeated rows of an anchor's id are
neither its positives nor its negatives, and repeated rows of other ids count one by one; repeated anchors give their rows
once each; a shorter vector reads as if zeros followed; a positive of negative score has an empty window; vectors whose
scores could exceed 2^62 are refused with an error; other columns, whatever their names, are ignored; an empty table, or
one without anchors, gives an empty table.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import smallest_by_hash, written

#: Rows that codebooks are fitted on, words of a codebook, rounds of fitting, most codebooks, groups of dimensions with a norm.
TRAIN_ROWS, WORDS, ROUNDS, BOOKS, GROUPS = 4096, 256, 8, 64, 8
#: Blobs of a chunk, anchors of a stripe; rows and anchors that are compared at once.
CHUNK, STRIPE, TILE_ROWS, TILE_ANCHORS = 64, 8192, 4096, 256
#: Units of an integer vector for 1.0.
UNIT = 256
#: Share of the norms' product by which sums of single-precision numbers can be off, with room to spare.
ROUNDING = 1e-5


def fit_books(sample: np.ndarray, dims: int) -> np.ndarray:
    """Codebooks (number of books, WORDS, dimensions of each) of integer vectors, by Lloyd's rounds in each subspace."""
    d = max(2, math.ceil(dims / BOOKS))
    m = max(1, math.ceil(dims / d))
    wide = np.zeros((len(sample), m * d), np.float32)
    wide[:, : sample.shape[1]] = sample
    books = np.zeros((m, WORDS, d), np.float32)
    for i in range(m if len(sample) else 0):
        x = wide[:, i * d : i * d + d]
        book = x[np.linspace(0, len(x) - 1, WORDS).astype(int)].copy()
        for _ in range(ROUNDS):
            near = nearest(x, book)
            count = np.bincount(near, minlength=WORDS)
            for j in range(d):
                total = np.bincount(near, weights=x[:, j], minlength=WORDS)
                book[:, j] = np.where(count > 0, total / np.maximum(count, 1), book[:, j])
        books[i] = book
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * x @ book.T).argmin(1)


def norms(x: np.ndarray, books: int) -> np.ndarray:
    """Norms (rows, groups) over the groups of dimensions, rounded up to single precision."""
    g = min(GROUPS, books)
    cuts = np.linspace(0, books, g + 1).astype(int)[:-1] * (x.shape[1] // books)
    n = np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, cuts, axis=1))
    return np.nextafter(n.astype(np.float32), np.float32(np.inf))


class Coder:
    """Integer vectors to codes and residual norms; scores with their bounds from lookup tables."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.m, _, self.d = books.shape

    def wide(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), self.m * self.d), q.dtype)
        out[:, : q.shape[1]] = q
        return out

    def encode(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual norms) of wide vectors."""
        codes = np.empty((len(q), self.m), np.uint8)
        left = q.astype(np.float64)
        for i in range(self.m):
            part = slice(i * self.d, i * self.d + self.d)
            codes[:, i] = nearest(q[:, part].astype(np.float32), self.books[i])
            left[:, part] -= self.books[i][codes[:, i]]
        return codes, norms(left, self.m)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(books, WORDS, anchors): products of anchors with each codeword."""
        a = anchors.astype(np.float32)
        return np.stack([self.books[i] @ a[:, i * self.d : i * self.d + self.d].T for i in range(self.m)])

    def bounds(self, tables: np.ndarray, anchor_norms: np.ndarray, codes: np.ndarray, left: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest score), rows by anchors; `size`: the largest norm among the rows."""
        score = np.zeros((len(codes), tables.shape[2]), np.float32)
        looked = np.empty_like(score)
        for i in range(self.m):
            np.take(tables[i], codes[:, i], axis=0, out=looked)
            score += looked
        off = left @ anchor_norms.T
        off *= 1 + ROUNDING
        off += ROUNDING * (np.sqrt((anchor_norms**2).sum(1)) * size + 1)
        return score - off, score + off


class Best:
    """The `most` best (score, then id, null ids last) for each owner, over what is added bit by bit."""

    def __init__(self, owners: int, most: int):
        self.most = most
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        self.worst = np.full(owners, np.iinfo(np.int64).min)  # score that a new row must reach

    def add(self, owner: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        o, s, n, i = (np.concatenate([a, b]) for a, b in zip(self.found, (owner, score, none, ids), strict=True))
        order = np.lexsort((i, n, -s, o))
        o, s, n, i = o[order], s[order], n[order], i[order]
        first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
        full = rank == self.most - 1
        self.worst[o[full]] = s[full]
        keep = rank < self.most
        self.found = [o[keep], s[keep], n[keep], i[keep]]


class Chunk:
    """Rows of some blobs, in order of label."""

    def __init__(self, blobs: pd.DataFrame, coder: Coder, dims: int, kind: str):
        put = lambda c, t, w=None: np.concatenate([np.frombuffer(b, t) if w is None else np.frombuffer(b, t).reshape(-1, w) for b in blobs[c]])
        labels = put("labels", np.int64)
        order = np.argsort(labels, kind="stable")
        self.labels, self.ids, self.none = labels[order], put("ids", np.int64)[order], put("none", bool)[order]
        self.q = put("q", kind, dims)[order].astype(np.int64)
        self.codes, self.left = put("codes", np.uint8, coder.m)[order], put("left", np.float32, min(GROUPS, coder.m))[order]

    def size(self, a: int, z: int) -> float:
        return float(np.sqrt((self.q[a:z].astype(np.float64) ** 2).sum(1).max()) * 2 + 1)


def _exact(anchors: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Integer scores of pairs, in slices."""
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", anchors[at[i : i + 65536]], rows[of[i : i + 65536]]) for i in range(0, len(at), 65536)]])


def best_of_label(chunk: Chunk, coder: Coder, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, most: int) -> Best:
    """For each anchor (its index), the best rows of its label in the chunk."""
    best = Best(len(ids), most)
    for label in np.unique(labels):
        a, z = np.searchsorted(chunk.labels, [label, label + 1])
        own = np.flatnonzero(labels == label)
        for i in range(0, len(own), TILE_ANCHORS):
            at = own[i : i + TILE_ANCHORS]
            tables, sizes = coder.tables(coder.wide(q[at])), norms(coder.wide(q[at]), coder.m)
            for j in range(a, z, TILE_ROWS):
                k = min(j + TILE_ROWS, z)
                low, high = coder.bounds(tables, sizes, chunk.codes[j:k], chunk.left[j:k], chunk.size(j, k))
                other = chunk.none[j:k, None] | (chunk.ids[j:k, None] != ids[at])
                low[~other], high[~other] = -np.inf, -np.inf
                floor = best.worst[at].astype(np.float64)
                if k - j > most:  # as many rows surely reach this
                    floor = np.maximum(floor, np.partition(low, k - j - most, axis=0)[k - j - most])
                row, col = np.nonzero(other & (high >= floor))
                best.add(at[col], _exact(q, at[col], chunk.q, row + j), chunk.none[row + j], chunk.ids[row + j])
    return best


def best_in_windows(chunk: Chunk, coder: Coder, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lows: np.ndarray, highs: np.ndarray, most: int) -> Best:
    """For each window (anchor index times windows each, plus its number), the best rows of other labels whose scores lie in it;
    `lows` and `highs` are (anchors, windows), the least and greatest scores."""
    each = lows.shape[1]
    best = Best(len(ids) * each, most)
    for i in range(0, len(ids), TILE_ANCHORS):
        at = np.arange(i, min(i + TILE_ANCHORS, len(ids)))
        tables, sizes = coder.tables(coder.wide(q[at])), norms(coder.wide(q[at]), coder.m)
        for j in range(0, len(chunk.ids), TILE_ROWS):
            k = min(j + TILE_ROWS, len(chunk.ids))
            low, high = coder.bounds(tables, sizes, chunk.codes[j:k], chunk.left[j:k], chunk.size(j, k))
            other = (chunk.labels[j:k, None] != labels[at]) & (chunk.none[j:k, None] | (chunk.ids[j:k, None] != ids[at]))
            may = np.zeros_like(other)
            for w in range(each):
                bottom, top = lows[at, w].astype(np.float64), highs[at, w].astype(np.float64)
                floor = np.maximum(bottom, best.worst[at * each + w])
                if k - j > most:
                    sure = np.where(other & (low >= bottom) & (high <= top), low, -np.inf)
                    floor = np.maximum(floor, np.partition(sure, k - j - most, axis=0)[k - j - most])
                may |= other & (high >= floor) & (low <= top)
            row, col = np.nonzero(may)
            score = _exact(q, at[col], chunk.q, row + j)
            for w in range(each):
                own = at[col] * each + w
                fits = (score >= lows[at[col], w]) & (score <= highs[at[col], w]) & (score >= best.worst[own])
                best.add(own[fits], score[fits], chunk.none[row[fits] + j], chunk.ids[row[fits] + j])
    return best


def mine(rows: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that `asks`, and each of
    its `positives` best other rows of its label, the first `negatives` rows of other labels whose score is `low` to `high`
    percent of the positive's."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    own = own.where(F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    most, far = own.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dims, far = max(most or 0, 1), UNIT * (far or 0.0) + 1
    if dims * far * far >= 2.0**62:
        raise ValueError(f"vectors of {dims} dimensions with components up to {far / UNIT:g} have scores beyond 2^62")
    kind = "<i4" if far < 2**31 else "<i8"

    def integers(lists: pa.Array) -> np.ndarray:
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), dims), np.int64)
        out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(UNIT * lists.flatten().to_numpy()).astype(np.int64)
        return out

    # A bounded sample; train_rows is its documented size.
    sample = smallest_by_hash(own, "id", train_rows, "v").select("v").toArrow().column("v").combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    coder = Coder(fit_books(integers(sample) if len(sample) else np.zeros((0, dims)), dims))
    blob = [("ids", pa.binary()), ("none", pa.binary()), ("labels", pa.binary()), ("q", pa.binary()), ("codes", pa.binary()), ("left", pa.binary())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = integers(b.column("v"))
                codes, left = coder.encode(coder.wide(q))
                ids = b.column("id")
                cols = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), b.column("label").to_numpy(), q.astype(kind), codes, left]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], schema=pa.schema(blob))

    asked = own.where(F.col("asks") & F.col("id").isNotNull())
    packed = written(own.select("id", "label", "v").mapInArrow(encode, ", ".join(f"{c} binary" for c, _ in blob)), "packed")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = integers(b.column("v")).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x.tobytes() for x in q], pa.binary())], names=["id", "label", "q"])

    # Anchors get numbers, which tell repeated ones apart; the table keeps them.
    anchors = written(asked.select("id", "label", "v").mapInArrow(ask, "id long, label long, q binary").withColumn("a", F.monotonically_increasing_id()), "anchors")
    blobs, n = packed.count(), anchors.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, stripes = max(1, min(blobs, max(parts, math.ceil(blobs / CHUNK)))), max(1, math.ceil(n / STRIPE))

    def met(asking: DataFrame, run, schema: str) -> DataFrame:
        """run(chunk, anchors) for each chunk of blobs with each stripe of anchors."""
        left = packed.withColumn("r", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        right = asking.withColumn("s", F.pmod(F.xxhash64("a"), F.lit(stripes)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

        def both(blobs: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            if blobs.empty or asking.empty:
                return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
            q = np.stack([np.frombuffer(b, kind) for b in asking["q"]]).astype(np.int64)
            return run(Chunk(blobs, coder, dims, kind), asking, asking["id"].to_numpy(np.int64), asking["label"].to_numpy(np.int64), q)

        return left.groupBy("r", "s").cogroup(right.groupBy("r", "s")).applyInPandas(both, schema)

    def rows_of(best: Best, owner: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
        o, score, none, ids = best.found
        return pd.DataFrame({"a": owner[o], **{c: x[o] for c, x in more.items()}, "id": pd.Series(ids, dtype="Int64").mask(none), "score": score})

    def first_pass(chunk: Chunk, asking: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        return rows_of(best_of_label(chunk, coder, ids, labels, q, positives), asking["a"].to_numpy())

    order = [F.desc("score"), F.asc_nulls_last("id")]
    near = met(anchors, first_pass, "a long, id long, score long").withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("place") <= positives)
    near = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("p"))
    # Each place of an anchor whose positives are fewer is an empty window.
    named = near.select("a", F.transform("p", lambda x: x["score"]).alias("scores"), F.transform("p", lambda x: x["id"]).alias("names"))
    asking = written(anchors.join(named, "a"), "windows")

    def second_pass(chunk: Chunk, asking: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        lows, highs = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        for i, scores in enumerate(asking["scores"]):
            for w, p in enumerate(scores):
                lows[i, w], highs[i, w] = -(-low * int(p) // 100), high * int(p) // 100
        best = best_in_windows(chunk, coder, ids, labels, q, lows, highs, negatives)
        places = np.tile(np.arange(positives, dtype=np.int32), len(ids))
        return rows_of(best, np.repeat(asking["a"].to_numpy(), positives), place=places)

    found = met(asking.select("a", "id", "label", "q", "scores"), second_pass, "a long, place int, id long, score long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    names = asking.select(F.col("a"), F.col("id").alias("anchor_id"), "names", "scores")
    out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(names, "a")
    return out.select("anchor_id", F.get("names", "place").alias("positive_id"), "rank", "negative_id", F.get("scores", "place").alias("positive_score"), "negative_score")

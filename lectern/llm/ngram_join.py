"""Exact Jaccard self-join of documents on word shingles: a token-group matrix.

1. A token that stands in one document only is in no overlap. Batches of texts send their distinct tokens, packed by hash
   bucket; a bucket answers each batch which of its tokens stand elsewhere, too (tokens of several documents of a batch go
   out once, so a token of all documents costs one posting per batch). A document keeps its shared tokens, and leaves when
   they are fewer than the overlap that a link needs. Of equal sets, only the first batch keeps one: a class.
2. Classes of equal smallest token (by a hash of the round) are compared with leaders among them, in ROUNDS rounds; those
   linked follow their leader, and only leaders enter the next round. Copies with small edits are connected after that.
3. What is left to find are links between followers of different leaders. By buckets again, classes keep the tokens that
   stand under several leaders, and leave when these are too few.
4. The classes left are partitioned into groups of similar ones (by their most common smallest token; blocks of GROUP tokens); each
   group's token union is stored as an index. A link of class q with a member shares need(q) tokens with the group's
   union, hence `least` of any |q| - need(q) + least of q's tokens; the rarest are looked up in the index. Groups that have
   fewer stay closed, and so do those of q's own leader only.
5. Members go only to where a class asks; there the bound by the whole union is tried first, then sets are compared by
   products of 0-1 matrices, without pairs that are connected already.
6. Components of the links, each named by its smallest document.

Steps drop only what a bound rules out or what is connected already, so components are exact; tokens are 48-bit hashes of
all bytes of a shingle, so that two sets of 500 count a wrong common token with a chance of 1e-9. Nothing is collected.
Every group that goes to one task is cut by size (`dealt`), each part with all rows of the other side.

Defined results: a document without words has an empty set and is its own component; equal sets link; a document with a
null id links like any other and is returned, but names no component (null if no document of it has an id); repeated rows
of one id count as one document each, with equal components; other columns are ignored; an empty table gives an empty
table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import mix, shingles
from lectern.llm.common import buckets, dealt, replayable, written
from lectern.llm.components import components

#: Rounds of leaders.
ROUNDS = 2
#: Tokens of the small groups that one call of a Python function gets together.
BUNDLE = 1 << 20
#: Tokens of a part of a round, of a group's block, and of the classes that are compared with a block in one task.
PART, GROUP, QUERIES = 1 << 17, 1 << 18, 1 << 19
#: Hashes by which classes find their group.
HASHES = 4
#: Share of the needed overlap (in hundredths) that is looked up in the index.
LOOKED_UP = 25
#: Characters per batch, and per slice of it that is hashed at once.
BATCH, PIECE = 1 << 21, 1 << 18
#: Leaders of a part that a class is compared with before it leads one of its own.
LEADERS = 8
TOKEN = np.uint64((1 << 48) - 1)


def need(n, threshold: int):
    """Smallest overlap at which a set of n tokens can reach the threshold (in hundredths)."""
    return -(-n * threshold // 100)


def pack(tokens: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each: the low halves, then the high ones."""
    return tokens.astype("<u4").tobytes() + (tokens >> np.uint64(32)).astype("<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, whether they are given, texts) of about BATCH characters each."""
    ids, given, texts, held = [], [], [], 0
    for pdf in pdfs:
        for i, g, t in zip(pdf["id"].tolist(), pdf["given"].tolist(), pdf["text"].tolist(), strict=True):
            ids.append(i)
            given.append(g)
            texts.append(t if isinstance(t, str) else None)
            held += len(texts[-1] or "")
            if held > BATCH:
                yield np.array(ids, np.int64), np.array(given, np.uint8), texts
                ids, given, texts, held = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(given, np.uint8), texts


def _hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of slices of PIECE characters: what it holds per byte stays small beside what it gives."""
    parts, some, held = [], [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held > PIECE:
            parts.append(shingles(some))
            some, held = [], 0
    parts.append(shingles(some))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.concatenate([np.diff(f) for _, f in parts]), out=first[1:])
    return np.concatenate([h for h, _ in parts]), first


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: sums of mixed tokens, mixed with the size; 0 for the empty set."""
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(0x5851F42D4C957F2D)), out=s[1:])
    n = np.diff(first).astype(np.uint64)
    sig = mix((s[first[1:]] - s[first[:-1]]) * np.uint64(0xD1342543DE82EF95) + n)
    sig[n == 0] = 0
    return sig.view(np.int64)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_):
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1], [True])))


def _by_bucket(bucket: np.ndarray, owner: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Per bucket: the places of its tokens in order of owners, and how many of them each owner has."""
    order = np.argsort(bucket * owners + owner, kind="stable")
    cut = _runs(bucket[order])
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        at = order[a:z]
        yield int(bucket[at[0]]), at, np.bincount(owner[at], minlength=owners).astype("<u4").tobytes()


POSTING = "bucket long, batch long, kind int, a binary, b binary, c binary"
#: Kinds of rows: tokens of a batch; those of several of its documents; names of classes; its documents.
TOKENS, INSIDE, NAMES, DOCS = range(4)


def _post(docs: DataFrame, n_buckets: int) -> DataFrame:
    """What each batch sends to the buckets (step 1). Batches are numbered by task and place, the same in every attempt."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        for k, (ids, given, texts) in enumerate(_batches(pdfs)):
            batch = base + k
            h, first = _hashed(texts)
            n, sig = np.diff(first), signatures(h, first)
            rows = [(batch % n_buckets, batch, DOCS, ids.tobytes() + given.tobytes(), n.astype("<i8").tobytes(), sig.tobytes())]
            _, one = np.unique(sig, return_index=True)
            one = np.sort(one[n[one] > 0])  # a class once per batch, in order
            held = np.zeros(len(n), bool)
            held[one] = True
            if len(one):
                names = sig[one].view(np.uint64)
                where = (mix(names + np.uint64(1)) % np.uint64(n_buckets)).astype(np.int64)
                for b, at, _ in _by_bucket(where, np.zeros(len(one), np.int64), 1):
                    rows.append((b, batch, NAMES, names[at].tobytes(), at.astype("<u4").tobytes(), None))
                t = h[np.repeat(held, n)] & TOKEN
                owner = np.repeat(np.arange(len(one)), n[one])
                order = np.argsort(t, kind="stable")
                t, owner = t[order], owner[order]
                cut = _runs(t)[:-1]
                count = np.diff(np.append(cut, len(t)))
                more = np.ones(len(t), bool)
                more[cut] = False
                if more.any():
                    x = np.flatnonzero(more)
                    x = x[np.argsort(owner[x], kind="stable")]
                    rows.append((batch % n_buckets, batch, INSIDE, pack(t[x]), np.bincount(owner[x], minlength=len(one)).astype("<u4").tobytes(), None))
                t, owner, several = t[cut], owner[cut], count > 1
                where = (mix(t) % np.uint64(n_buckets)).astype(np.int64)
                for b, at, counts in _by_bucket(where, owner, len(one)):
                    rows.append((b, batch, TOKENS, pack(t[at]), counts, np.packbits(several[at]).tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "batch", "kind", "a", "b", "c"])

    return docs.select("id", "given", "text").mapInPandas(run, POSTING)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers: tokens that stand elsewhere or in several documents of a batch, and names that an earlier batch
    has; other rows pass."""
    kind = pdf["kind"].to_numpy()
    out = [pdf[(kind == INSIDE) | (kind == DOCS)]]
    asked = pdf[kind == TOKENS]
    if len(asked):
        parts = [unpack(a) for a in asked["a"]]
        sizes = np.array([len(p) for p in parts])
        t, own = np.concatenate(parts), np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=n).astype(bool) for c, n in zip(asked["c"], sizes, strict=True)])
        del parts
        order = np.argsort(t)
        x = t[order]
        again = np.zeros(len(x), bool)
        again[1:] = x[1:] == x[:-1]
        again[:-1] |= again[1:]
        shared = own
        shared[order[again]] = True
        rows, begin = [], 0
        for batch, n, b in zip(asked["batch"], sizes.tolist(), asked["b"], strict=True):
            keep = shared[begin : begin + n]
            counts = np.frombuffer(b, "<u4")
            owner = np.repeat(np.arange(len(counts)), counts)[keep]
            rows.append((0, batch, TOKENS, pack(t[begin : begin + n][keep]), np.bincount(owner, minlength=len(counts)).astype("<u4").tobytes(), None))
            begin += n
        out.append(pd.DataFrame(rows, columns=pdf.columns))
    asked = pdf[kind == NAMES]
    if len(asked):
        sizes = [len(a) // 8 for a in asked["a"]]
        sig, at, batch = np.frombuffer(b"".join(asked["a"]), np.uint64), np.frombuffer(b"".join(asked["b"]), "<u4"), np.repeat(asked["batch"].to_numpy(), sizes)
        order = np.lexsort((batch, sig))
        late = order[1:][sig[order][1:] == sig[order][:-1]]
        late = late[np.argsort(batch[late], kind="stable")]
        cut = _runs(batch[late])
        out.append(pd.DataFrame([(0, int(batch[late[a]]), NAMES, None, at[late[a:z]].tobytes(), None) for a, z in zip(cut[:-1], cut[1:], strict=True)], columns=pdf.columns))
    return pd.concat(out, ignore_index=True)


def lowest(tokens: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """The smallest token of each set (none is empty) by the hash of a round."""
    return np.minimum.reduceat(mix(tokens ^ np.uint64(0xA0761D6478BD642F * (2 * number + 1) % (1 << 64))), first[:-1]).view(np.int64)


KEPT = "id long, given boolean, n long, sig long, lows array<bigint>, size long, tokens binary"


def _keep(threshold: int):
    """From all rows of a batch: its documents (id, n, sig), and the classes left with their shared tokens."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = pdf[pdf["kind"] == DOCS].iloc[0]
        n, sig = np.frombuffer(doc["b"], "<i8"), np.frombuffer(doc["c"], np.int64)
        ids, given = np.frombuffer(doc["a"], np.int64, len(n)), np.frombuffer(doc["a"], np.uint8, len(n), 8 * len(n))
        out = [pd.DataFrame({"id": ids, "given": given.astype(bool), "n": n, "sig": sig, "lows": None, "size": None, "tokens": None})]
        _, one = np.unique(sig, return_index=True)
        one = np.sort(one[n[one] > 0])
        asked = pdf[(pdf["kind"] == TOKENS) | (pdf["kind"] == INSIDE)]
        if len(one) and len(asked):
            t = np.concatenate([unpack(a) for a in asked["a"]])
            owner = np.concatenate([np.repeat(np.arange(len(one)), np.frombuffer(b, "<u4")) for b in asked["b"]])
            wanted = np.bincount(owner, minlength=len(one)) >= need(n[one], threshold)
            for b in pdf.loc[pdf["kind"] == NAMES, "b"]:
                wanted[np.frombuffer(b, "<u4")] = False
            keep = wanted[owner]
            t, owner = t[keep], owner[keep]
            order = np.lexsort((t, owner))
            t, cut = t[order], _runs(owner[order])
            if len(t):
                c = one[wanted]
                lows = np.stack([lowest(t, cut, r) for r in range(ROUNDS)], axis=1)
                out.append(pd.DataFrame({"id": None, "given": None, "n": n[c], "sig": sig[c], "lows": list(lows), "size": np.diff(cut), "tokens": [pack(t[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]}))
        return pd.concat(out, ignore_index=True).astype({"id": "Int64", "given": "boolean", "size": "Int64"})

    return run


def linked(q: np.ndarray, n: int, sets: list[np.ndarray], ns: np.ndarray, threshold: int) -> np.ndarray:
    """Which of the sets (shared tokens, sorted; whole sizes ns) link with q (whole size n)."""
    out = np.zeros(len(sets), bool)
    fit = np.flatnonzero(100 * np.minimum(ns, n) >= threshold * np.maximum(ns, n))
    if not len(fit):
        return out
    every = np.concatenate([sets[i] for i in fit])
    at = np.minimum(np.searchsorted(q, every), len(q) - 1)
    starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in fit])[:-1]))
    both = np.add.reduceat((q[at] == every).astype(np.int64), starts)
    out[fit] = 100 * both >= threshold * (n + ns[fit] - both)
    return out


def overlaps(queries: list[np.ndarray], members: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0-1 matrices over the tokens that several of the sets have, a block of
    columns at a time: counts under 2 ** 24 are exact in single precision."""
    flat = np.concatenate([*queries, *members])
    owner = np.repeat(np.arange(len(queries) + len(members)), [len(x) for x in (*queries, *members)])
    tokens, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    column, owner = shared[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(queries), len(members)), np.int64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, z = np.searchsorted(column, [begin, begin + columns])
        m = np.zeros((len(queries) + len(members), columns), np.float32)
        m[owner[a:z], column[a:z] - begin] = 1
        out += (m[: len(queries)] @ m[len(queries) :].T).astype(np.int64)
    return out


LED = "sig long, leader long, n long, lows array<bigint>, size long, tokens binary"


def _lead(sets: DataFrame, number: int, threshold: int, whole: bool) -> DataFrame:
    """Each class with its leader (step 2): itself unless it links with an earlier leader of its part. Followers carry
    their tokens on only if `whole`."""

    def one(sigs: np.ndarray, counts: np.ndarray, raws: list[bytes]) -> list[int]:
        names, sets_, ns, out = [], [], [], []
        for sig, n, raw in zip(sigs.tolist(), counts.tolist(), raws, strict=True):
            q = unpack(raw)
            hit = np.flatnonzero(linked(q, n, sets_, np.array(ns), threshold)) if names else []
            out.append(names[hit[0]] if len(hit) else sig)
            if not len(hit) and len(names) < LEADERS:
                names.append(sig)
                sets_.append(q)
                ns.append(n)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["low", "part", "sig"], ignore_index=True)
        sig, n, raws = pdf["sig"].to_numpy(), pdf["n"].to_numpy(), pdf["tokens"].tolist()
        leader = sig.copy()
        for a, z in _groups(pdf["low"].to_numpy(), pdf["part"].to_numpy()):
            if z - a > 1:
                leader[a:z] = one(sig[a:z], n[a:z], raws[a:z])
        pdf["leader"] = leader
        if not whole:
            pdf["tokens"] = pdf["tokens"].where(pdf["leader"] == pdf["sig"], None)
        return pdf[["sig", "leader", "n", "lows", "size", "tokens"]]

    parts = dealt(sets.withColumn("low", F.col("lows")[number]), "low", "size", PART, "sig")
    return _bundled(parts, sets, "low", "part").applyInPandas(run, LED)


def _groups(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    if len(keys[0]):
        new = np.ones(len(keys[0]) + 1, bool)
        new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        cut = np.flatnonzero(new).tolist()
        yield from zip(cut[:-1], cut[1:], strict=True)


def _bundled(rows: DataFrame, sizes: DataFrame, *keys: str):
    """rows grouped into bundles of whole groups by `keys`, of about BUNDLE tokens each as `sizes` sums them: a call of a
    Python function costs milliseconds, and most groups have two rows."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUNDLE))
    return rows.withColumn("bundle", F.pmod(F.xxhash64(*keys), F.lit(n))).groupBy("bundle")


def _outside(led: DataFrame, n_buckets: int, threshold: int) -> DataFrame:
    """(sig, leader, n, lows, size, tokens, rare, least): classes (sig, leader, n, tokens) with at least need(n) tokens that stand
    under several leaders (step 3); `rare` are those to look up, the least frequent ones."""

    def post(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if not len(pdf):
                continue
            parts = [unpack(x) for x in pdf["tokens"]]
            t, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            who = pdf[["sig", "leader", "n"]].to_numpy(np.int64)
            rows = []
            for b, at, counts in _by_bucket((mix(t) % np.uint64(n_buckets)).astype(np.int64), owner, len(parts)):
                c = np.frombuffer(counts, "<u4")
                rows.append((b, pack(t[at]), who[c > 0].tobytes(), c[c > 0].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "a", "who", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.concatenate([unpack(a) for a in pdf["a"]])
        who = np.frombuffer(b"".join(pdf["who"]), np.int64).reshape(-1, 3)
        owner = np.repeat(np.arange(len(who)), np.frombuffer(b"".join(pdf["counts"]), "<u4"))
        order = np.argsort(t)
        t, owner = t[order], owner[order]
        cut = _runs(t)
        leader = who[owner, 1]
        several = np.minimum.reduceat(leader, cut[:-1]) != np.maximum.reduceat(leader, cut[:-1])
        count = np.diff(cut)
        keep = np.repeat(several, count)
        t, owner, often = t[keep], owner[keep], np.repeat(np.minimum(count, 1 << 31), count)[keep]
        to = (mix(who[:, 0].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        rows = []
        for b, at, counts in _by_bucket(to[owner], owner, len(who)):
            c = np.frombuffer(counts, "<u4")
            rows.append((b, pack(t[at]), who[c > 0].tobytes(), c[c > 0].tobytes(), often[at].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["to", "a", "who", "counts", "often"])

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        t, often = np.concatenate([unpack(a) for a in pdf["a"]]), np.frombuffer(b"".join(pdf["often"]), "<u4")
        who, counts = np.frombuffer(b"".join(pdf["who"]), np.int64).reshape(-1, 3), np.frombuffer(b"".join(pdf["counts"]), "<u4")
        names, inverse = np.unique(who[:, 0], return_inverse=True)
        row = np.zeros((len(names), 3), np.int64)
        row[inverse] = who
        owner = np.repeat(inverse, counts)
        wanted = np.bincount(owner, minlength=len(names)) >= need(row[:, 2], threshold)
        x = wanted[owner]
        t, often, owner = t[x], often[x], owner[x]
        order = np.lexsort((t, owner))
        t, often, cut = t[order], often[order], _runs(owner[order])
        out = []
        for (sig, leader, n), a, z in zip(row[wanted].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own, least = t[a:z], least_common(need(n, threshold))
            first = np.argsort(often[a:z], kind="stable")[: z - a - need(n, threshold) + least]
            lows = [int(lowest(own, np.array([0, len(own)]), r)[0]) for r in range(HASHES)]
            out.append((sig, leader, n, lows, z - a, pack(own), own[first].astype(np.int64), least))
        return pd.DataFrame(out, columns=["sig", "leader", "n", "lows", "size", "tokens", "rare", "least"])

    posted = led.select("sig", "leader", "n", "tokens").mapInPandas(post, "bucket long, a binary, who binary, counts binary")
    answers = posted.groupBy("bucket").applyInPandas(answer, "to long, a binary, who binary, counts binary, often binary")
    return answers.groupBy("to").applyInPandas(keep, "sig long, leader long, n long, lows array<bigint>, size long, tokens binary, rare array<bigint>, least long")


def _grouped(left: DataFrame) -> DataFrame:
    """(sig, size, group): of a class's smallest tokens by several hashes, the one that most classes have names its group, so
    that edited copies of one text mostly share a group. Any partition gives the same links."""
    lows = left.select("sig", "size", F.posexplode("lows").alias("r", "low"))
    often = lows.groupBy("r", "low").agg(F.count("*").alias("c"))
    best = lows.join(often, ["r", "low"]).groupBy("sig", "size").agg(F.max(F.struct("c", "r", "low")).alias("x"))
    return best.select("sig", "size", F.xxhash64("x.r", "x.low").alias("group"))


def least_common(needed: int) -> int:
    """How many tokens of the looked-up ones a class shares with the union of a group that it may link with."""
    return max(1, needed * LOOKED_UP // 100)


def _unions(members: DataFrame) -> DataFrame:
    """(token, g, one, last): each group's token union, with the smallest and largest leader of the group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", ignore_index=True)
        g, leader, raws = pdf["g"].to_numpy(), pdf["leader"].to_numpy(), pdf["tokens"].tolist()
        rows = [(g[a], np.unique(np.concatenate([unpack(x) for x in raws[a:z]])).astype(np.int64), leader[a:z].min(), leader[a:z].max()) for a, z in _groups(g)]
        return pd.DataFrame(rows, columns=["g", "tokens", "one", "last"])

    packed = _bundled(members, members, "g").applyInPandas(run, "g long, tokens array<bigint>, one long, last long")
    return packed.select(F.explode("tokens").alias("token"), "g", "one", "last")


def _open(candidates: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between classes, from candidates (sig, to): at least one for each two leaders' classes that link (step 5)."""
    asks = candidates.join(members.select("sig", "size"), "sig").withColumnRenamed("to", "g")
    asks = written(dealt(written(asks, "asks"), "g", "size", QUERIES, "sig").select("sig", "g", "part"), "asks")
    asking = asks.join(members.select("sig", "leader", "n", "tokens"), "sig").withColumn("asks", F.lit(1))
    parts = asks.select("g", "part").distinct()  # a group's members go to each part of those that ask
    inside = parts.join(members.select("g", "sig", "leader", "n", "tokens"), "g").withColumn("asks", F.lit(0))
    columns = ["g", "part", "asks", "sig", "leader", "n", "tokens"]

    def one(pdf: pd.DataFrame, found: list[tuple[int, int]]) -> None:
        inside, asking = pdf[pdf["asks"] == 0], pdf[pdf["asks"] == 1].sort_values(["leader", "sig"])
        sets, sigs, sizes = [unpack(t) for t in inside["tokens"]], inside["sig"].tolist(), inside["n"].to_numpy()
        union = np.unique(np.concatenate(sets))
        asked = []
        for sig, own, n, raw in zip(asking["sig"].tolist(), asking["leader"].tolist(), asking["n"].tolist(), asking["tokens"], strict=True):
            q = unpack(raw)
            at = np.minimum(np.searchsorted(union, q), len(union) - 1)
            if int((union[at] == q).sum()) >= need(n, threshold):
                asked.append((sig, own, n, q))  # for the others the group stays closed: no member can have enough of q
        label = inside["leader"].to_numpy().copy()  # of what is connected as far as this task knows
        same: dict[int, int] = {}
        for i in range(0, len(asked), 500):
            some = asked[i : i + 500]
            both = overlaps([q for *_, q in some], sets)
            for (sig, own, n, _), row in zip(some, both, strict=True):
                own = same.get(own, own)
                for j in np.flatnonzero((100 * row >= threshold * (n + sizes - row)) & (label != own)).tolist():
                    old = int(label[j])
                    if old != own:
                        found.append((sig, sigs[j]))
                        same = {k: own if v == old else v for k, v in same.items()} | {old: own}
                        label[label == old] = own

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        pdf = pdf.sort_values(["g", "part", "asks", "sig"], ignore_index=True)
        for a, z in _groups(pdf["g"].to_numpy(), pdf["part"].to_numpy()):
            one(pdf.iloc[a:z], found)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rows = asking.select(columns).union(inside.select(columns))
    return _bundled(rows, asks.join(members.select("sig", "size"), "sig"), "g", "part").applyInPandas(run, "a long, b long")


def ngram_jaccard(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every document; threshold in hundredths. See the module's text."""
    n_buckets = buckets(docs)
    docs = replayable(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")))
    docs = docs.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("given"), "text")
    kept = written(_post(docs, n_buckets).groupBy("bucket").applyInPandas(_answer, POSTING).groupBy("batch").applyInPandas(_keep(threshold), KEPT), "kept")
    sizes = kept.where("tokens is null").select(F.when(F.col("given"), F.col("id")).alias("id"), "n", "sig")
    led = written(_lead(kept.where("tokens is not null"), 0, threshold, True), "led")
    leaders, active = led.select("sig", "leader"), led.where("sig = leader")
    links = leaders.where("sig != leader")
    for r in range(1, ROUNDS):
        step = written(_lead(active, r, threshold, False), "round")
        active = step.where("sig = leader")
        links = links.union(step.select("sig", "leader").where("sig != leader"))
        leaders = leaders.join(step.select(F.col("sig").alias("leader"), F.col("leader").alias("next")), "leader", "left").select("sig", F.coalesce("next", "leader").alias("leader"))
    labelled = led.drop("leader").join(leaders, "sig")
    left = written(_outside(labelled, n_buckets, threshold), "outside")
    blocks = dealt(_grouped(left), "group", "size", GROUP, "sig").select("sig", F.xxhash64("group", "part").alias("g"))
    members = written(left.drop("lows").join(blocks, "sig"), "members")
    unions = written(_unions(members), "unions")
    rare = members.select("sig", "g", "leader", "least", F.explode("rare").alias("token"))
    # A class asks the groups from its own upwards, where they have other leaders' classes.
    pairs = rare.join(unions.select("token", F.col("g").alias("to"), "one", "last"), "token").where("g <= to and (one != leader or last != leader)")
    candidates = written(pairs.groupBy("sig", "to", "least").agg(F.count("*").alias("c")).where("c >= least").select("sig", "to"), "candidates")
    links = written(links.toDF("a", "b").union(_open(candidates, members, threshold)), "links")
    comp = written(components(links), "components")
    classes = sizes.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"))
    names = comp.join(classes, comp["node"] == classes["sig"]).groupBy("component").agg(F.min("id").alias("name"))
    of_class = classes.join(comp.join(names, "component").select(F.col("node").alias("sig"), "name"), "sig", "left").select("sig", F.coalesce("name", "id").alias("component_id"))
    out = sizes.join(of_class, "sig", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


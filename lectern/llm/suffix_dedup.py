"""Removal of long byte strings that occur earlier in the corpus, by suffix arrays over shards.

A byte goes if a string of `length` (100) bytes covers it that also starts earlier: in a document of smaller id, or in
the same document further left. Equal strings have to meet in one shard, whatever documents they are in:

1. Of the 32-byte grams of a 100-byte string, the one of smallest hash is its anchor. Neighbouring strings mostly share
   their anchor; a segment is a run of such strings. Equal strings have equal anchors, so anchors are the shard key.
   Each batch keeps one entry per anchor and segment content, the earliest; the others are covered already.
2. Per bucket of anchors, segments of equal content (by 128 bits of hashes) are covered but for the earliest. Anchors of
   one segment only are done. Where an anchor has several different segments, their strings may still agree in part.
3. Those segments are cut from the texts and gathered in shards by anchor. A shard's suffix array is built by induced
   sorting, its permuted common prefixes give the runs of suffixes that agree in 100 bytes, and all but the earliest of
   a run are covered.
4. Anchors of very many occurrences (a line of boilerplate), which a sketch of constant size finds, would fill one
   shard: their segments are dealt out string by string instead, by each string's own hash.
5. Covered intervals meet their documents, overlaps are merged, and the rest of the bytes is kept.

Every string of every text is judged on the input; nothing is capped or sampled, and no step collects rows.

Defined results: a null or empty text has no bytes; a row with a null id keeps all its bytes and covers none; rows that
share an id are variants of one document (strings at the same start don't remove each other, covers apply to each row);
other columns are ignored; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytewords import flat, mix, prefix_sums, spans_hash
from lectern.llm.common import buckets, written
from lectern.llm.sketch import SLOTS, batches, heavy_slots
from lectern.llm.suffix_array import permuted_prefixes, suffix_array

#: Bytes of an anchor gram.
GRAM = 32
#: Low bits of a window key that hold the place in the batch.
PLACE = np.uint64((1 << 28) - 1)
#: Occurrences above which an anchor is dealt out string by string; what one shard holds of one anchor stays under it.
HOT = 50_000
#: Bytes of segments per shard.
SHARD = 4 << 20
#: Bytes of segments per suffix array, unless a single anchor has more.
WHOLE = 1 << 19


def segments(texts: list[str | None], length: int = 100) -> tuple[np.ndarray, ...]:
    """(document index, start in it, strings, anchor hash, content hash, flat start, prefix sums) of every segment."""
    b, ends = flat(texts)
    window = length - GRAM + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64), np.zeros(1, np.uint64))
    if len(b) > int(PLACE) + 1:
        raise ValueError(f"{len(b)} bytes of text in one batch: a place has {int(PLACE).bit_length()} bits, so a single text may have {int(PLACE) + 1} bytes at most")
    if len(b) < length:
        return none
    sums = prefix_sums(b)
    at = np.arange(len(b) - GRAM + 1)
    gram = spans_hash(sums, at, at + GRAM)
    key = (gram & ~PLACE) | at.astype(np.uint64)
    low, width = key, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if window > width:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    sizes = np.diff(ends)
    strings = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), strings)
    if not len(doc):
        return none
    start = np.arange(len(doc)) - np.repeat(np.cumsum(strings) - strings, strings)
    place = ends[doc] + start
    anchor = (low[place] & PLACE).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    place, anchor = place[first], anchor[first]
    content = spans_hash(sums, place, place + count + length - 1)
    shape = mix(((anchor - place) * 256 + count).astype(np.uint64))
    return doc[first], start[first], count, gram[anchor], mix(content ^ shape), place, sums


def _first_of(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, document and start; which of this order begin a group of equal keys; which stand at another place
    than their group's first (those occur earlier)."""
    order = np.lexsort((start, doc, *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = (doc[order] != doc[order][head]) | (start[order] != start[order][head])
    return order, new, again


def _sketch(docs: DataFrame, length: int) -> DataFrame:
    """Counts of anchors per slot, in 16 parts from each task."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for _, texts in batches(pdfs, "id", "text"):
            counts += np.bincount((segments(texts, length)[3] >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        parts = counts.reshape(16, -1)
        yield pd.DataFrame({"part": range(16), "counts": [p.astype("<i4" if p.max() < 1 << 31 else "<i8").tobytes() for p in parts]})

    return docs.mapInPandas(run, "part int, counts binary")


def _entries(docs: DataFrame, heavy: np.ndarray, n_buckets: int, length: int) -> DataFrame:
    """Entries packed by bucket; bucket -1 has what a batch covers itself."""
    packed = np.packbits(heavy)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = np.unpackbits(packed).astype(bool)
        for ids, texts in batches(pdfs, "id", "text"):
            at, start, count, anchor, content, place, sums = segments(texts, length)
            if not len(at):
                continue
            doc = ids[at]
            order, new, again = _first_of([content, anchor], doc, start)
            own = order[again]
            keep = order[new]
            is_hot = hot[(anchor[keep] >> np.uint64(44)).astype(np.int64)]
            cold, many = keep[~is_hot], keep[is_hot]
            # A hot segment becomes its strings, each with its own hash for anchor.
            n = count[many]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = spans_hash(sums, np.repeat(place[many], n) + step, np.repeat(place[many], n) + step + length)
            e = [
                np.concatenate([anchor[cold], mix(h + np.uint64(1))]),
                np.concatenate([content[cold], h]),
                np.concatenate([doc[cold], np.repeat(doc[many], n)]),
                np.concatenate([start[cold], np.repeat(start[many], n) + step]).astype(np.int32),
                np.concatenate([count[cold], np.ones(len(step), np.int64)]).astype(np.uint8),
            ]
            b = (mix(e[0]) % np.uint64(n_buckets)).astype(np.int64)
            if len(own):
                e = [np.concatenate([x, y]) for x, y in zip(e, [anchor[own], content[own], doc[own], start[own].astype(np.int32), count[own].astype(np.uint8)], strict=True)]
                b = np.concatenate([b, np.full(len(own), -1)])
            order = np.lexsort((e[3], e[2], b))
            b = b[order]
            e = [x[order] for x in e]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
            for i in range(0, len(cut) - 1, 64):
                spans = list(zip(cut[i : i + 64], cut[i + 1 : i + 65], strict=False))
                yield pd.DataFrame({"bucket": b[cut[i : i + 64][: len(spans)]], **{c: [x[a:z].tobytes() for a, z in spans] for c, x in zip(("anchor", "content", "doc", "start", "count"), e, strict=True)}})

    return docs.mapInPandas(run, "bucket long, anchor binary, content binary, doc binary, start binary, count binary")


def _unpacked(pdf: pd.DataFrame) -> list[np.ndarray]:
    kinds = {"anchor": np.uint64, "content": np.uint64, "doc": np.int64, "start": np.int32, "count": np.uint8}
    return [np.frombuffer(b"".join(pdf[c]), k) for c, k in kinds.items()]


def _judge(entries: DataFrame, length: int) -> DataFrame:
    """(doc, start, end, anchor) of segments: covered where anchor is null, else to be compared by their bytes."""
    schema = "doc long, start int, end int, anchor long, ask boolean"

    def rows(doc, start, count, anchor, ask) -> pd.DataFrame:
        return pd.DataFrame({"doc": doc, "start": start, "end": start + count.astype(np.int32) + np.int32(length - 1), "anchor": anchor.view(np.int64), "ask": ask})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, content, doc, start, count = _unpacked(pdf)
        order = np.argsort(anchor)
        again = np.zeros(len(order), bool)
        again[1:] = anchor[order][1:] == anchor[order][:-1]
        again[:-1] |= again[1:]
        anchor, content, doc, start, count = (x[order[again]] for x in (anchor, content, doc, start, count))
        order, new, again = _first_of([content, anchor], doc, start)
        covered, first = order[again], order[new]
        a = anchor[first]  # in order: one per segment content
        several = np.zeros(len(a), bool)
        several[1:] = a[1:] == a[:-1]
        several[:-1] |= several[1:]
        ask = first[several]
        both = np.concatenate([covered, ask])
        return rows(doc[both], start[both], count[both], anchor[both], np.arange(len(both)) >= len(covered))

    def own(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            anchor, _, doc, start, count = _unpacked(pdf)
            yield rows(doc, start, count, anchor, np.zeros(len(doc), bool))

    return entries.where("bucket >= 0").groupBy("bucket").applyInPandas(run, schema).union(entries.where("bucket < 0").mapInPandas(own, schema))


def shard_covers(doc: np.ndarray, start: np.ndarray, parts: list[bytes], length: int = 100) -> list[tuple[int, int, int]]:
    """Intervals (doc, start, end) that a shard's suffix array finds covered, among segments at the given places."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(p + b"\x00" for p in parts), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.arange(len(text)) - (ends - sizes)[owner]
    sa = suffix_array(text, length)
    shared = permuted_prefixes(text, sa, length)  # UTF-8 has no byte 255, so symbols fit a byte
    group = np.cumsum(shared[sa] < length)
    valid = inside[sa] + length <= sizes[owner[sa]]
    sa, group = sa[valid], group[valid]
    d, s = doc[owner[sa]], start[owner[sa]] + inside[sa]
    order, _, again = _first_of([group], d, s)
    at = np.sort(sa[order[again]])
    if not len(at):
        return []
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)))
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    o = owner[first]
    return list(zip(doc[o].tolist(), (start[o] + inside[first]).tolist(), (start[o] + inside[last] + length).tolist(), strict=True))


def _compare(asked: DataFrame, texts: DataFrame, shards: int, length: int) -> DataFrame:
    """(doc, start, end) covered, among the segments asked for: their bytes are cut, dealt to shards and sorted."""
    wanted = asked.groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in ("start", "end", "anchor")])

    names = ["shard", "anchor", "doc", "start", "part"]

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for doc, text, starts, ends, anchors in zip(pdf["doc"], pdf["text"], pdf["start"], pdf["end"], pdf["anchor"], strict=True):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                out += [(a % shards, a, doc, s, raw[s:e]) for a, s, e in zip(anchors.tolist(), starts.tolist(), ends.tolist(), strict=True) if e <= len(raw)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        # Anchors one after another, as many as WHOLE holds per suffix array: memory follows that, not the shard.
        pdf = pdf.sort_values("anchor", kind="stable")
        anchor, size = pdf["anchor"].to_numpy(), pdf["part"].map(len).to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        total = np.add.reduceat(size, begin)
        cut = begin[np.concatenate(([True], np.diff((np.cumsum(total) - total) // WHOLE) > 0))]
        found = []
        for a, z in zip(cut, [*cut[1:], len(pdf)], strict=True):
            own = pdf.iloc[a:z]
            found += shard_covers(own["doc"].to_numpy(), own["start"].to_numpy(np.int64), list(own["part"]), length)
        return pd.DataFrame(found, columns=["doc", "start", "end"]).astype({"doc": "int64", "start": "int32", "end": "int32"})

    parts = texts.join(wanted, texts["id"] == wanted["doc"]).select("doc", "text", "start", "end", "anchor").mapInPandas(cut, "shard long, anchor long, doc long, start int, part binary")
    return parts.groupBy("shard").applyInPandas(sort, "doc long, start int, end int")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; intervals that touch are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row; with keep_text, also the kept bytes (binary)."""
    spark = docs.sparkSession
    every = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    named = every.where("id is not null")
    counted = written(_sketch(named, length), "anchors")
    heavy = heavy_slots(counted, hot)
    found = written(_judge(_entries(named, heavy, buckets(named), length), length), "segments")
    asked = found.where("ask")
    size = asked.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD + 1)
    # Both uses of the texts read one exchange.
    dealt = named.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets(named)), "id")
    covers = found.where("not ask").select("doc", "start", "end").union(_compare(asked, dealt, shards, length))
    covers = covers.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = dealt.join(covers, dealt["id"] == covers["doc"], "left").select("id", "text", "starts", "ends")
    joined = joined.union(every.where("id is null").select("id", "text", F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>")))

    def apply(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), 500):
                out = []
                part = pdf.iloc[i : i + 500]
                for doc, t, starts, ends in zip(part["id"], part["text"], part["starts"], part["ends"], strict=True):
                    raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                    s = e = np.zeros(0, np.int64)
                    if starts is not None and len(starts):
                        s, e = merged(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
                        s, e = s[s < len(raw)], np.minimum(e[s < len(raw)], len(raw))
                    kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                    out.append((doc, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"id": "Int64"})

    out = joined.mapInPandas(apply, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", key)
    return out if keep_text else out.drop("kept")

"""BPE encoding and decoding with batched numpy merge rounds.

The new words of a batch are laid out in one flat array of symbols. A round finds every adjacent pair's rank by binary
search over the sorted pair keys, each word's lowest rank, and merges that pair wherever it stands in the word, for all
words at once. A word is encoded once per task and then looked up, so the rounds see each distinct word only.

The tokenizer file says what is done: NFC, white space runs to one space, lower case, a split pattern, byte-level
symbols with a word end, merges by rank; special tokens in a text are matched before anything else. A decoded text is
the token strings with a space between them, since the file names no decoder.

Defined results: a null or empty text has no tokens and decodes to the empty string; texts of any length are encoded
whole; very long words leave the rounds for a heap, with the same result; other columns stay; an empty table gives an
empty table.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Chunks between spaces that a worker remembers, and their characters; beyond either the memory starts anew, and results
#: stay the same.
REMEMBERED, REMEMBERED_CHARS = 200_000, 4_000_000
#: Symbols above which a word is merged by a heap rather than in rounds.
LONG_WORD = 400
#: White_Space of Unicode (fixed values).
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


#: Letters that Unicode 16 and 17 added and the library knows, where Python's database is older; and the lower case of those
#: that are capitals, by the first and last of a run (fixed values).
LATER_LETTERS = "1C89-1C8A A7CB-A7CE A7D2 A7D4 A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 16EA0-16EB8 18CFF 1E5D0-1E5ED 1E5F0"
LATER_CAPITALS = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"


def _runs(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(z or a, 16)) for a, _, z in (x.partition("-") for x in text.split())]


LOWER = {a + i: int(to, 16) + i for run, _, to in (x.partition(">") for x in LATER_CAPITALS.split()) for a, z in _runs(run) for i in range(z - a + 1)}
_CAPITAL = re.compile("[" + "".join(map(chr, LOWER)) + "]")


def lower(text: str) -> str:
    """Lower case as the library has it."""
    return (text.translate(LOWER) if not text.isascii() and _CAPITAL.search(text) else text).lower()


def _classes() -> tuple[str, str]:
    """Regular expression classes of letters and of numbers, from Python's Unicode database and LATER_LETTERS."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    out = []
    for kind in "LN":
        runs, start = [], None
        for c in [*every, ""]:
            inside = c != "" and unicodedata.category(c)[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                runs.append(f"{re.escape(start)}-{re.escape(last)}")
                start = None
            last = c
        out.append("".join(runs))
    return out[0] + "".join(f"{chr(a)}-{chr(z)}" for a, z in _runs(LATER_LETTERS)), out[1]


class WordBPE:
    """A tokenizer file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters, numbers = _classes()
        self.spaces = re.compile(f"[{UNICODE_SPACE}]+")
        self.separators = re.compile("[\x1c-\x1f]")
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{UNICODE_SPACE}{letters}{numbers}]+")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(self.strings) + 1
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.final = np.array([self.vocab[s + self.suffix] for s in symbols], np.int64)
        self.known: dict[str, tuple[str, str, int]] = {}
        self.known_chars = 0

    def chunks(self, text: str) -> list[str]:
        """A text without special tokens, normalised and cut at white space. No word of the split pattern crosses white
        space, so a chunk is encoded the same wherever it stands."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Capital sigma becomes the plain small one wherever it stands; str.lower would look at its place in the word.
        text = lower(text.replace("Σ", "σ"))
        if self.separators.search(text):  # str.split takes these for white space, Unicode doesn't
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: rounds over all words, a heap for very long ones."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        short = []
        for i, b in enumerate(raw):
            if len(b) > LONG_WORD:
                out[i] = self._merge_long(b)
            else:
                short.append(i)
        if not short:
            return out
        lengths = np.array([len(raw[i]) for i in short])
        flat = np.frombuffer(b"".join(raw[i] for i in short), np.uint8)
        owner = np.repeat(np.arange(len(short)), lengths)
        sym = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.final[flat[ends]]
        none = len(self.keys)
        done_sym, done_owner = [], []
        while True:
            pair = np.full(len(sym), none, np.int64)
            inside = owner[:-1] == owner[1:]
            pair[:-1][inside] = self._ranks(sym[:-1][inside], sym[1:][inside])
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.append(starts, len(owner)))
            low = np.minimum.reduceat(pair, starts)
            if (finished := low == none).any():  # words without a pair left leave the rounds
                gone = np.repeat(finished, counts)
                done_sym.append(sym[gone])
                done_owner.append(owner[gone])
                if finished.all():
                    break
                sym, owner, pair = sym[~gone], owner[~gone], pair[~gone]
                counts, low = counts[~finished], low[~finished]
            hit = pair == np.repeat(low, counts)
            # Of overlapping pairs (as in a run of one symbol) every second is merged, from the left.
            runs = hit[1:] & hit[:-1]
            if runs.any():
                at = np.arange(len(hit))
                begin = hit & ~np.concatenate(([False], hit[:-1]))
                first = np.maximum.accumulate(np.where(begin, at, 0))
                hit &= (at - first) % 2 == 0
            sym = sym.copy()
            sym[hit] = self.made[pair[hit]]
            keep = np.concatenate(([True], ~hit[:-1]))
            sym, owner = sym[keep], owner[keep]
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        sym, owner = sym[order], owner[order]
        cut = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
        ids = sym.tolist()
        for k, i in enumerate(short):
            out[i] = ids[cut[k] : cut[k + 1]]
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """One word with a heap of (rank, place) over a linked list: n log n in its length."""
        sym = self.inner[np.frombuffer(raw, np.uint8)].tolist()
        sym[-1] = int(self.final[raw[-1]])
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank_of.get(sym[i] * self.size + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if sym[i] < 0 or (j := after[i]) >= n or self.rank_of.get(sym[i] * self.size + sym[j]) != r:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := self.rank_of.get(sym[a] * self.size + sym[after[a]])) is not None:
                    heapq.heappush(heap, (x, a))
        return [s for s in sym if s >= 0]

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes chunks that aren't known yet, all their words in the same rounds."""
        split = {c: self.pattern.findall(c) for c in chunks}
        words = list({w for ws in split.values() for w in ws})
        ids = dict(zip(words, self.merge(words), strict=True))
        strings = self.strings
        for c, ws in split.items():
            own = [i for w in ws for i in ids[w]]
            self.known[c] = (" ".join(map(str, own)), " ".join([strings[i] for i in own]), len(own))

    def split(self, text: str | None) -> list[str | int]:
        """Chunks and ids of special tokens, in order."""
        if not text:
            return []
        if self.split_special is None or not any(s in text for s in self.special):
            return self.chunks(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.chunks(part)
        return out

    def batch(self, texts: list[str | None]) -> Iterator[list[tuple[str, str, int]]]:
        """For each text, (ids, token strings, count) of each of its chunks that has tokens."""
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
            self.known.clear()
            self.known_chars = 0
        new = set().union(*split).difference(self.known)
        for i in [c for c in new if isinstance(c, int)]:
            self.known[i] = (str(i), self.strings[i], 1)
            new.discard(i)
        if new:
            self.known_chars += sum(map(len, new))
            self.learn(new)
        known = self.known
        for s in split:
            yield [w for w in map(known.__getitem__, s) if w[2]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for word in next(self.batch([text])) for i in word[0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The token strings of known ids, with a space between them; special tokens are kept."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """One per worker process and file."""
    return WordBPE(path)


def _slices(texts: pd.Series, chars: int = 1 << 20) -> Iterator[slice]:
    """Slices of a batch with about so many characters each, so that a batch of very long texts stays small in memory."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held > chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _clean(s: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in s]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`, an array of the token ids of each whole text."""
    kept = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for pdf in batches:
            for part in _slices(pdf[text]):
                own = pdf[part].copy()
                own[ids] = [[int(i) for w in words for i in w[0].split()] for words in t.batch(_clean(own[text]))]
                yield own

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema.fields)
    return docs.select(*[f"`{c}`" for c in kept]).mapInPandas(run, f"{schema}, `{ids}` array<int>")


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with `decoded`, the decoded string of each array of ids (null: empty)."""
    kept = [c for c in tokens.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for pdf in batches:
            pdf[text] = [t.decode(x) if x is not None else "" for x in pdf[ids]]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*[f"`{c}`" for c in kept]).schema.fields)
    return tokens.select(*[f"`{c}`" for c in kept]).mapInPandas(run, f"{schema}, `{text}` string")


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the number of tokens and digests of its ids and of the text decoded from them."""

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for pdf in batches:
            for part in _slices(pdf[text]):
                rows = []
                for words in t.batch(_clean(pdf[text][part])):
                    rows.append((sum([w[2] for w in words]), digest(" ".join([w[0] for w in words])), digest(" ".join([w[1] for w in words]))))
                yield pd.DataFrame({key: pdf[key][part]}).join(pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=pdf[key][part].index))

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

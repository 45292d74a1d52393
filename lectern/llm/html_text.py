"""Main text of web pages: structure first, then a suffix array over each host's token streams.

A scanner cuts a page into blocks and notes for each what its open elements say: inside an article (or main) and outside
menus, headers, footers, sidebars, notices, adverts, forms and comments; inside one of those; or undecided, on pages
without such elements. Per host, the tokens of the blocks that structure doesn't settle are concatenated, and a suffix
array finds runs of RUN tokens or more that stand on several distinct pages. They are cut out of undecided blocks; the
unique rest is kept. Pages with the same sequence of blocks are one page, so copies don't make each other boilerplate.

Blocks inside an article are not dropped for being repeated: articles quote and share passages, and a menu inside an
article is marked as one. So where a page names its article, structure alone settles it.

Hosts of many pages are dealt to parts by page id, of about PART characters each. A run may stand once in each of two
parts, so parts also send the hashes of their runs, with the pages they stand on, to buckets of the host by hash; a
bucket answers each part which of its runs stand on several pages of the whole host. Size of a host changes no result.

Defined results: a null or empty html gives an empty text; unclosed and crossed tags end where an outer element ends; a
null or odd url counts as the host ""; repeated pages keep their articles; other columns are ignored; an empty table
gives an empty table.
"""
from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.suffix_array import permuted_prefixes, suffix_array

#: Elements whose content is never text.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "select", "title"}
#: Elements that hold no main text, by name and by role.
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Parts of a class or id that mark other than main text; "navy" and "menuetto" are none.
ASIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertis(?:ing|ements?)|sponsor(?:s|ed)?|promos?|promotion(?:s|al)?|banner|navs?|navbar|navigation|menus?|menubar|breadcrumbs?|sidebar|footer|cookies?|consent|newsletter|subscribe|comments?|recommended|popup|modal|pagination|pager|login|signup)(?:$|[\s_-])", re.I)
#: Words that mark other text only where all other parts of the name are neutral: "share-bar" is one, "share-price" is not.
UNSURE = frozenset("side header notice notices replies discussion respond share social related widget".split())
NEUTRAL = frozenset("site page top bottom left right global main primary secondary box bar list section area wrap wrapper container block link links button buttons item items inner outer panel form tools posts articles stories media icons".split())
MAIN = {"article", "main"}
#: Elements that begin and end a block.
BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "tr", "td", "th", "caption", "thead", "tbody", "section", "article", "main", "figure", "figcaption", "hr", "address", "body", "html", "details", "summary", "fieldset"} | ASIDE
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: A value's quote that is never closed is no quote: its tag ends at the next ">". No alternative gives back what it took.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
#: Lower case that changes no length: end tags are ASCII.
LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"\s+")
#: Tokens of a repeated run, distinct pages it stands on, and characters of html per part of a host.
RUN, PAGES, PART = 6, 2, 8 << 20
OPEN, INSIDE, OUTSIDE = 0, 1, 2
#: Odd factors of the hash of a run: one for each token, and one for how many they are.
MIX = np.random.default_rng(1).integers(0, 1 << 63, RUN + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _marks_aside(names: str) -> bool:
    """Whether a class or id says that an element is beside the main text."""
    if ASIDE_WORDS.search(names):
        return True
    for name in names.lower().split():
        parts = [p for p in re.split("[_-]", name) if p and not p.isdigit()]
        if any(p in UNSURE for p in parts) and all(p in UNSURE or p in NEUTRAL for p in parts):
            return True
    return False


def _aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE:
        return not (name == "header" and in_main)  # an article's own header has its title
    if "=" not in attributes and "hidden" not in attributes:
        return False
    said = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    if name in MAIN or name in ("body", "html"):
        return False
    return said.get("role", "").lower() in ASIDE_ROLES or said.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", QUOTED.sub('""', attributes))) or any(_marks_aside(said[k]) for k in ("class", "id") if k in said)


def _main(name: str, attributes: str) -> bool:
    if name in MAIN:
        return True
    return "=" in attributes and any(m[0].lower() == "role" and "main" in (m[1] or m[2] or m[3]).lower().split() for m in ATTRIBUTE.findall(attributes))


def blocks(page: str) -> list[tuple[int, str]]:
    """(OPEN, INSIDE or OUTSIDE, text) of each block of a page, in order; raw elements and comments are gone. A page
    names its article if the scanner opened an article or main element, by tag or role; else its blocks are OPEN."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, aside, main
    opened: Counter[str] = Counter()  # names in the stack: an end tag of another name ends nothing
    main = asides = 0
    named = False

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((OUTSIDE if asides else INSIDE if main else OPEN, text))
            held.clear()

    at, end, low = 0, len(page), None
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1] == "/"
        if name in RAW and not closing:
            if m[3].endswith("/"):
                continue
            low = page.translate(LOWER) if low is None else low
            close = low.find(f"</{name}", at)
            at = end if close < 0 else page.find(">", close) + 1 or end
            if name == "title":
                flush()
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            held.append(" ")
            continue
        if name in VOID:
            continue
        if name in BLOCK and stack and stack[-1][0] == "p" and (not closing or name != "p"):
            _, aside, is_main = stack.pop()  # a block ends an open paragraph
            opened["p"] -= 1
            asides -= aside
            main -= is_main
        if not closing:
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "b", "i", "em", "strong", "span", "a") and not m[3].strip():
                continue  # says nothing about the region, and is often left open
            aside, is_main = _aside(name, m[3], main > 0), _main(name, m[3])
            named = named or is_main
            stack.append((name, aside, is_main))
            opened[name] += 1
            asides += aside
            main += is_main
        elif opened[name] > 0:
            found = ""
            while found != name:
                found, aside, is_main = stack.pop()
                opened[found] -= 1
                asides -= aside
                main -= is_main
    flush()
    return [(OUTSIDE if kind == OPEN else kind, text) for kind, text in out] if named else out


def repeated_runs(streams: list[list[int]], pages_of: list[int], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream of tokens (numbers from 1; a block), which tokens a run covers that stands on `pages` distinct pages.

    Runs of neighbouring suffixes that agree in `run` tokens are found in the suffix array of the concatenation, with 0
    after each block, so that no run crosses two. Blocks shorter than a run are runs as a whole."""
    lengths = np.array([len(s) + 1 for s in streams])
    text = np.concatenate([np.array([*s, 0], np.int64) for s in streams])
    owner = np.repeat(np.arange(len(streams)), lengths)
    # Bytes of the tokens' numbers, most significant first, as many as the largest needs: the induced sort works on small symbols.
    b = max(3, (int(text.max()).bit_length() + 7) // 8)
    wide = np.stack([text >> 8 * k & 255 for k in reversed(range(b))], axis=1).astype(np.uint8).ravel()
    sa = suffix_array(wide, b * run)
    shared = permuted_prefixes(wide, sa, b * run)
    group = np.cumsum(shared[sa] < b * run)
    left = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(len(text))
    page = np.array(pages_of)[owner]
    whole = np.concatenate(([True], text[:-1] == 0)) & (left < run) & (left > 0)  # a short block agrees up to its 0
    use = (sa % b == 0) & ((left[sa // b] >= run) | whole[sa // b])
    at, group = sa[use] // b, group[use]
    if len(at):
        short = whole[at]
        if short.any():  # such blocks are equal if all their tokens and the 0 are: grouped by content
            names: dict[tuple, int] = {}
            group = group.copy()
            group[short] = [-1 - names.setdefault(tuple(text[i : i + left[i]].tolist()), len(names)) for i in at[short].tolist()]
        pairs = np.unique(np.stack([group, page[at]], axis=1), axis=0)
        ids, count = np.unique(pairs[:, 0], return_counts=True)
        at = at[np.isin(group, ids[count >= pages])]
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + np.minimum(run, left[at]), -1)
    covered = np.cumsum(cover[:-1]) > 0
    cuts = np.cumsum(lengths)
    return [covered[a : b - 1] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


def run_hashes(streams: list[list[int]], words: Iterable[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, first token, tokens, 64-bit hash) of each run that repeated_runs compares: `run` tokens of a block, or a
    shorter block as a whole. words are the tokens in the order of their numbers; hashes depend on content only."""
    lengths = np.array([len(s) for s in streams], np.int64)
    text = np.concatenate([np.array(s, np.int64) for s in streams])
    owner = np.repeat(np.arange(len(streams)), lengths)
    first = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[owner] - first
    at = np.flatnonzero((left >= run) | (first == 0))
    size = np.minimum(left[at], run)
    codes = np.frombuffer(b"".join([bytes(8), *(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words)]), np.uint64)
    hashed = size.astype(np.uint64) * MIX[run]
    for j in range(run):
        live = size > j
        hashed[live] += codes[text[at[live] + j]] * MIX[j]
    return owner[at], first[at], size, hashed


def host_texts(pages: list[list[tuple[int, str]]], known: np.ndarray | None = None) -> list[tuple[str, int]]:
    """(main text, boilerplate tokens found by repetition) of pages of one host, or of a part of it, given their blocks;
    `known` has hashes of runs that stand on several pages of the whole host."""
    number: dict[str, int] = {}
    streams, page_of, at, same = [], [], {}, {}
    for i, own in enumerate(pages):
        page = same.setdefault(tuple(own), i)  # copies of a page are that page
        for j, (kind, text) in enumerate(own):
            if kind != INSIDE:
                at[i, j] = len(streams)
                streams.append([number.setdefault(t, len(number) + 1) for t in text.split()])
                page_of.append(page)
    covered = repeated_runs(streams, page_of) if streams else []
    if streams and known is not None and len(known):
        owner, first, size, hashed = run_hashes(streams, number)
        hit = np.isin(hashed, known)
        for k, a, n in zip(owner[hit].tolist(), first[hit].tolist(), size[hit].tolist(), strict=True):
            covered[k][a : a + n] = True
    out = []
    for i, own in enumerate(pages):
        cover = {j: covered[at[i, j]] for j in range(len(own)) if (i, j) in at}
        kept = [t if kind == INSIDE or not cover[j].any() else " ".join(w for w, c in zip(t.split(), cover[j].tolist(), strict=True) if not c) for j, (kind, t) in enumerate(own) if kind != OUTSIDE]
        out.append(("\n".join(t for t in kept if t), sum(int(c.sum()) for c in cover.values())))
    return out


def _joined(found: list[tuple[int, str]]) -> tuple[str, bytes]:
    """The texts of blocks as one, and the length of each: no character is a separator."""
    return "".join(t for _, t in found), np.array([len(t) for _, t in found], "<i4").tobytes()


def _apart(texts: str | None, sizes: bytes) -> list[str]:
    ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
    return [texts[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's runs by bucket: (hash, least and greatest page of the part that it stands on), as numbers in a blob."""
    pdf = pdf.drop_duplicates("page")
    number: dict[str, int] = {}
    streams, page_of = [], []
    for page, texts, sizes in zip(pdf["page"], pdf["texts"], pdf["sizes"], strict=True):
        for t in _apart(texts, sizes):
            streams.append([number.setdefault(w, len(number) + 1) for w in t.split()])
            page_of.append(page)
    host, part, n = pdf["host"].iloc[0], pdf["part"].iloc[0], int(pdf["parts"].iloc[0])
    rows = []
    if any(streams):
        owner, _, _, hashed = run_hashes(streams, number)
        page = np.array(page_of, np.int64)[owner]
        order = np.lexsort((page, hashed, hashed % np.uint64(n)))
        hashed, page = hashed[order], page[order]
        start = np.flatnonzero(np.concatenate(([True], hashed[1:] != hashed[:-1])))
        found = np.stack([hashed[start].view(np.int64), page[start], page[np.append(start[1:], len(page)) - 1]], axis=1)
        bucket = (hashed[start] % np.uint64(n)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = [(host, part, int(bucket[a]), found[a:b].tobytes()) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=True)]
    return pd.DataFrame(rows, columns=["host", "part", "bucket", "runs"])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each part, the hashes among its runs of a bucket that stand on several pages of the host, but on one of the part."""
    own = [np.frombuffer(b, np.int64).reshape(-1, 3) for b in pdf["runs"]]
    found = np.concatenate(own)
    _, which = np.unique(found[:, 0], return_inverse=True)
    least, most = np.full(which.max() + 1, np.iinfo(np.int64).max), np.full(which.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, which, found[:, 1])
    np.maximum.at(most, which, found[:, 2])
    new = (least[which] != most[which]) & (found[:, 1] == found[:, 2])
    ends = np.cumsum([len(x) for x in own])
    rows = [(h, p, x[new[e - len(x) : e], 0].tobytes()) for h, p, x, e in zip(pdf["host"], pdf["part"], own, ends.tolist(), strict=True)]
    return pd.DataFrame([x for x in rows if x[2]], columns=["host", "part", "known"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_repeated) of every page: its main text, its code points, and how many tokens outside
    the article the host's suffix array found repeated."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    own = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html"), host.alias("host"))
    # Only hosts of several parts; as a written table its size is known, and Spark broadcasts it if it is small.
    parts = written(own.groupBy("host").agg(F.ceil(F.coalesce(F.sum(F.length("html")), F.lit(0)) / PART).alias("parts")).where("parts > 1"), "parts")
    dealt = own.join(parts, "host", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                found = [blocks(t) if isinstance(t, str) else [] for t in part["html"]]
                joined = [_joined(f) for f in found]
                yield part[["id", "url", "host", "part"]].assign(kinds=[bytes(k for k, _ in f) for f in found], texts=[t for t, _ in joined], sizes=[n for _, n in joined])

    def scan_runs(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                found = [blocks(t) if isinstance(t, str) else [] for t in part["html"]]
                whole = [(bytes(k for k, _ in f), *_joined(f)) for f in found]
                names = [hashlib.blake2b(kinds + sizes + text.encode("utf-8", "surrogatepass"), digest_size=8).digest() for kinds, text, sizes in whole]
                joined = [_joined([x for x in f if x[0] != INSIDE]) for f in found]
                yield part[["host", "part", "parts"]].assign(page=np.frombuffer(b"".join(names), np.int64), texts=[t for t, _ in joined], sizes=[n for _, n in joined])

    def group(pdf: pd.DataFrame, known: np.ndarray | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        own = [list(zip(k, _apart(t, n), strict=True)) for k, t, n in zip(pdf["kinds"], pdf["texts"], pdf["sizes"], strict=True)]
        done = host_texts(own, known)
        return pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": [t for t, _ in done], "n_chars": [len(t) for t, _ in done], "n_repeated": [n for _, n in done]})

    kind = pages.select(f"`{key}`").schema[0].dataType.simpleString()
    scanned = dealt.select("id", "url", "html", "host", "part").mapInPandas(scan, f"id {kind}, url string, host string, part long, kinds binary, texts string, sizes binary").groupBy("host", "part")
    result = f"id {kind}, url string, text string, n_chars long, n_repeated long"
    if parts.isEmpty():
        out = scanned.applyInPandas(lambda pdf: group(pdf), result)
    else:
        # Pages of such hosts are scanned twice: that takes less disk than a table of their blocks.
        runs = dealt.where("parts > 1").select("html", "host", "part", "parts").mapInPandas(scan_runs, "host string, part long, parts long, page long, texts string, sizes binary")
        asked = runs.groupBy("host", "part").applyInPandas(_ask, "host string, part long, bucket long, runs binary")
        known = asked.groupBy("host", "bucket").applyInPandas(_answer, "host string, part long, known binary")
        out = scanned.cogroup(known.groupBy("host", "part")).applyInPandas(lambda pdf, k: group(pdf, np.frombuffer(b"".join(k["known"]), np.uint64)), result)
    return out.withColumnsRenamed({"id": key, "url": url})

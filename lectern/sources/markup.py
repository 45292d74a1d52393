"""Text nodes of web pages as rows: where they stand in the element tree, and which of them a reader sees.

A page is scanned once, in Arrow batches; what the scan gives is a table of nodes, and the rules are columns over it.

Defined results: a null page has no nodes; elements that are never closed end with their parent; a page without an article
or main element is read as a whole."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.page_text import NO_TEXT

#: Elements whose text is never read, by their own name and by that of any ancestor; elements without an end.
SKIPPED = tuple("script style noscript textarea input select option code pre kbd samp svg math canvas".split())
INSIDE = ("code", "pre", "math", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening one of the same group ends (fixed values).
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROOTS = ("article", "main")
#: A comment, a declaration, or a tag with its attributes. A value's quote that is never closed is none; nothing that was
#: taken is given back, so any page is read in linear time.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
#: Elements whose content has no tags (fixed values).
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
#: Lower case that changes no length: end tags are ASCII.
LOWER = {c: c + 32 for c in range(65, 91)}
FIELDS = [("node", "long"), ("tag", "string"), ("path", "string"), ("depth", "int"), ("rooted", "boolean"), ("hidden", "boolean"), ("held", "boolean"), ("text", "string")]


class _Tree:
    """Emits text nodes with their element, its path, and what its ancestors say."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]  # tag, number, rooted, hidden, held
        self.counts: list[dict[str, int]] = [{}]
        self.nodes: list[tuple] = []
        self.root = False  # whether an article or main element was opened
        self.parts: list[str] = []
        self.open: Counter[str] = Counter()

    def _flush(self) -> None:
        if any(self.parts):
            tag, _, rooted, hidden, held = self.stack[-1]
            path = "".join(f"/{x[0]}[{x[1]}]" for x in self.stack[1:])
            self.nodes.append((len(self.nodes), tag, path, len(self.stack) - 1, rooted, hidden, held, unescape("".join(self.parts))))
            self.parts.clear()

    def _pop(self) -> None:
        self._flush()
        self.open[self.stack.pop()[0]] -= 1
        self.counts.pop()

    def read(self, page: str) -> None:
        at, low = 0, None
        while m := TAG.search(page, at):
            if m.start() > at:
                self.parts.append(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.begin(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                low = page.translate(LOWER) if low is None else low
                close = low.find(f"</{tag}", at)
                at, inner = (len(page), page[at:]) if close < 0 else (close, page[at:close])
                self.parts.append(inner)
        self.parts.append(page[at:])
        self._flush()

    def begin(self, tag: str, attributes: str) -> None:
        self._flush()
        while len(self.stack) > 1 and self.stack[-1][0] in ENDS.get(tag, ()):
            self._pop()
        here = self.counts[-1]
        here[tag] = here.get(tag, 0) + 1
        if tag in VOID:
            return
        said: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(attributes):
            said.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or "").strip().lower())
        _, _, rooted, hidden, held = self.stack[-1]
        if not self.root and (tag in ROOTS or said.get("role") == "main"):
            self.root = rooted = True
        style = said.get("style", "").replace(" ", "")
        hidden = hidden or "hidden" in said or "display:none" in style or "visibility:hidden" in style
        held = held or tag in INSIDE or said.get("aria-hidden") == "true" or said.get("contenteditable", "false") != "false"
        self.stack.append((tag, here[tag], rooted, hidden, held))
        self.counts.append({})
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self._flush()
        if self.open[tag] > 0:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()


def nodes_of(page: str) -> list[tuple]:
    """(node, tag, path, depth, rooted, hidden, held, text) of each text node, in order. rooted: inside the first article or
    main element; if there is none, all are."""
    tree = _Tree()
    tree.read(page)
    return tree.nodes if tree.root else [(*x[:4], True, *x[5:]) for x in tree.nodes]


def text_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node, tag, path, depth, rooted, hidden, held, text) of all text nodes of pages."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = [], []
            for i, page in enumerate(b.column(1).to_pylist()):
                own = nodes_of(page) if page else []
                row += [i] * len(own)
                found += own
            cols = list(zip(*found, strict=True)) if found else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, kinds[k]) for c, (_, k) in zip(cols, FIELDS, strict=True)]], names=[key, *[n for n, _ in FIELDS]])

    schema = f"`{key}` {dict(pages.dtypes)[key]}, " + ", ".join(f"{n} {k}" for n, k in FIELDS)
    return pages.select(key, html).mapInArrow(run, schema)


def readable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that a reader sees and a translation is for: in the main part, of two characters or more that are not only digits
    and marks, not hidden, and in no field, script, code or formula."""
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return nodes.where(F.col("rooted") & ~F.col("hidden") & ~F.col("held") & ~F.col("tag").isin(*SKIPPED) & (F.length(text) >= 2) & ~text.rlike(NO_TEXT))

"""Positioned tokens of pages to lines, lines to blocks with roles, captions to the regions of their figures and tables.

Three steps need the order of a page: which tokens are on one baseline and which of them make a line, which lines make a
block, and which regions captions have. Each is a fold over one page in its own group and says no more than what belongs
together, with its text and box; roles and levels are derived from that as columns. A page has some thousands of tokens at
most, whatever the table; pages are dealt out by (doc, page), so nothing but the size of one page bounds a task. lines_of and
blocks_of take one page, so where a row has its pages whole (runs.folded_within), no token or line is shuffled.

Defined results: tokens without text are none; equal tokens (operators.layout.without_repeated_tokens) should be taken out
before; ties of place are read in the order of their texts; a page without lines has no blocks, one without captions no regions."""
from __future__ import annotations

import re
from bisect import insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import page_text as T
from lectern.functions.split import reference_start
from lectern.operators.layout import PAGE
from lectern.operators.runs import folded_groups
from lectern.shared import written

#: Fixed values of the rules. Tolerance of a baseline in points and in font sizes, for tokens and for fragments of lines.
BASELINE, FRAGMENT = (2.5, 0.48), (2.2, 0.38)
#: A gap that ends a line, in points and font sizes; share of the page beyond which a smaller gap does.
CUT, LONG_LINE, SMALL_CUT = (12.0, 1.65), 0.62, 0.7
#: Members of a caption at most, and shares of a page's width that make a block span it.
MOST_MEMBERS, SPANS, HEADING_SPANS = 18, 0.68, 0.55
#: Weight of a block's text for the body's font size: least and greatest.
WEIGHT = (20, 1200)
LINE = "text string, x double, right double, y double, bottom double, baseline double, font double, cells int"
#: Fields of a token as folds get it, and of a block as they give it.
TOKENS = ["x", "text", "right", "width", "y", "bottom", "baseline", "font", "eol"]
BLOCK = "block long, text string, x double, y double, width double, height double, font double, line_height double, n_lines long, body double, caption boolean, reference boolean, level int, section int, title boolean, own boolean, lines array<double>"
#: White space as in the statements: ASCII's.
BLANK, NO_TEXT = re.compile(r"\s+", re.ASCII), re.compile(T.NO_TEXT, re.ASCII)
ENDED, DANGLING, PANEL, ACRONYMS, BARE = (re.compile(p) for p in (T.ENDED, T.DANGLING, T.PANEL, T.ACRONYMS, T.BARE_LABEL))


# --- Lines ------------------------------------------------------------------------------------------------------------------


def middle_of(values: list[float]) -> float:
    """The median of numbers that are in order already."""
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def baselines(tokens: list[tuple[float, float]], least: float, share: float) -> list[int]:
    """The number of its baseline for each (baseline, font), which stand in order of their baselines: the first whose median
    is near enough for the larger of the two font sizes; medians follow their members."""
    ats: list[list[float]] = []
    fonts: list[list[float]] = []
    middles: list[tuple[float, float]] = []
    out, reach, begin = [], max([least, *(share * f for _, f in tokens)]), 0
    for at, font in tokens:
        while begin < len(middles) and middles[begin][0] < at - reach:
            begin += 1  # no later token is nearer
        near, n = begin, len(middles)
        while near < n and abs(middles[near][0] - at) > max(least, max(middles[near][1], font) * share):
            near += 1
        if near == n:
            ats.append([at])
            fonts.append([font])
            middles.append((at, font))
        else:
            ats[near].append(at)  # in order, as the tokens are
            insort(fonts[near], font)
            middles[near] = (middle_of(ats[near]), middle_of(fonts[near]))
        out.append(near)
    return out


def cuts(tokens: list[tuple[float, float, float, bool]], page_width: float) -> list[int]:
    """The number of its line for each (x, right, font, ends its line) of one baseline, in order of x."""
    out: list[int] = []
    line, fonts, begin, right, ended = 0, [], 0.0, float("-inf"), False
    for x, r, font, last in tokens:
        if fonts:
            size, gap = middle_of(fonts), x - right
            if ended or gap > max(CUT[0], size * CUT[1]) or (r - begin > page_width * LONG_LINE and gap > size * SMALL_CUT):
                line, fonts = line + 1, []
        if not fonts:
            begin = x
        insort(fonts, font)
        right, ended = max(right, r), last
        out.append(line)
    return out


def line_of(tokens: list[tuple]) -> tuple:
    """(text, x, right, y, bottom, baseline, font, cells) of a line's TOKENS in order of x: a space where the gap is wider than
    a letter's."""
    before, parts = tokens[0], [tokens[0][1]]
    for t in tokens[1:]:
        if t[0] - before[2] > max(1.2, min(before[7], t[7]) * 0.14):
            parts.append(" ")
        parts.append(t[1])
        before = t
    text = BLANK.sub(" ", "".join(parts)).strip(" ")
    xs, _, rights, _, ys, bottoms, at, fonts, _ = zip(*tokens, strict=True)
    font = fonts[0] if min(fonts) == max(fonts) else weighted_middle((t[7], max(t[3], float(len(t[1])))) for t in tokens)
    return text, min(xs), max(rights), min(ys), max(bottoms), middle_of(sorted(at)), font, len(tokens)


def lines_of(rows: list[tuple], page_width: float) -> list[tuple]:
    """The numbered lines (LINE behind the number) of one page's TOKENS in order of baseline, x and text."""
    bands: dict[int, list[tuple]] = {}
    for band, row in zip(baselines([(r[6], r[7]) for r in rows], *BASELINE), rows, strict=True):
        bands.setdefault(band, []).append(row)
    made = []
    for band, part in bands.items():
        part.sort(key=itemgetter(0))
        of = cuts([(r[0], r[2], r[7], r[8]) for r in part], page_width)
        start = 0
        for i in range(1, len(of) + 1):
            if i == len(of) or of[i] != of[start]:
                line = line_of(part[start:i])
                if len(line[0]) > 1 and not NO_TEXT.search(line[0]):
                    made.append((line[3], line[1], band, of[start], line))
                start = i
    made.sort(key=itemgetter(0, 1, 2, 3))
    return [(n, *m[4]) for n, m in enumerate(made, 1)]


def _folded_tokens(tokens: DataFrame, run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What run makes of each page's TOKENS in order of baseline, x and text."""
    eol = F.coalesce(F.col("eol").cast("boolean"), F.lit(False)) if "eol" in tokens.columns else F.lit(False)
    own = tokens.where(F.col("text") != "").select(*PAGE, *[F.col(c).cast("double").alias(c) if c != "text" else F.col(c) for c in TOKENS[:-1]], eol.alias("eol"))
    return folded_groups(own, PAGE, [F.asc_nulls_last(c) for c in ("baseline", "x", "text")], TOKENS, run, schema)


def lines(tokens: DataFrame, page_width: float) -> DataFrame:
    """(doc, page, line, text, x, right, y, bottom, baseline, font, cells) of tokens (doc, page, text, x, right, width, y,
    bottom, baseline, font; eol, whether it ends its line, if there): tokens of one baseline up to a wide gap, numbered from
    top to bottom. Lines of one character or of nothing but digits and marks are left out."""
    return _folded_tokens(tokens, lambda rows: lines_of(rows, page_width), f"line long, {LINE}")


# --- Blocks -----------------------------------------------------------------------------------------------------------------


@dataclass
class Line:
    text: str
    x: float
    right: float
    y: float
    bottom: float
    baseline: float
    font: float
    cells: int

    @property
    def width(self) -> float:
        return self.right - self.x


class Block:
    """Lines that belong together. The box only grows; the font size is the median of the lines'."""

    def __init__(self, lines: Iterable[Line]):
        self.lines: list[Line] = []
        for line in lines:
            self.add(line)

    def add(self, line: Line) -> None:
        if not self.lines:
            self.text, self.x, self.right, self.y, self.bottom = line.text, line.x, line.right, line.y, line.bottom
        else:
            self.text = glued(self.text, line.text)
            self.x, self.right, self.y, self.bottom = min(self.x, line.x), max(self.right, line.right), min(self.y, line.y), max(self.bottom, line.bottom)
        self.lines.append(line)
        self.font = median([x.font for x in self.lines])

    @property
    def width(self) -> float:
        return self.right - self.x

    @property
    def place(self) -> tuple[float, float]:
        return self.y, self.x

    def cells(self) -> int:
        return max(x.cells for x in self.lines)


def glued(before: str, after: str) -> str:
    return before[:-1] + after if before[-1:] in "-‐‑‒–" and before and re.match("[a-z]", after) else f"{before} {after}"


def shared(a, b) -> float:
    """Points of width that two boxes share."""
    return max(0.0, min(a.right, b.right) - max(a.x, b.x))


def weighted_middle(pairs: Iterable[tuple[float, float]]) -> float:
    pairs = sorted(p for p in pairs if p[1] > 0)
    half, total = sum(w for _, w in pairs) / 2, 0.0
    for value, weight in pairs:
        total += weight
        if total >= half:
            return value
    return 0.0


def continues(block: Block, line: Line, page_width: float) -> bool:
    """Whether a line goes on with a block: near below its last line, of like size, aligned with it, and no new paragraph."""
    last, full = block.lines[-1], page_width * SPANS
    size, gap = max(6.0, (last.font + line.font) / 2), line.y - last.bottom
    if not -size * 0.3 <= gap <= size * 1.05 or max(last.font, line.font) / max(1.0, min(last.font, line.font)) > 1.38:
        return False
    aligned = abs(line.x - last.x) <= size * 1.6 or abs(line.right - last.right) <= size * 1.8
    if not aligned and shared(last, line) / max(1.0, min(last.width, line.width)) < 0.58:
        return False
    if (block.width > full) != (line.width > full) and len(block.lines) > 1:
        # A short last line may end a paragraph across the page.
        if not (block.width > full and abs(line.x - block.x) <= size * 1.6 and gap <= size * 0.65 and not ENDED.search(block.text)):
            return False
    indented = len(block.lines) >= 2 and line.x > block.x + size * 0.9 and last.x <= block.x + size * 0.45
    return not indented


def stacked(lines: Iterable[Line], page_width: float) -> list[Block]:
    """Blocks of lines that come from top to bottom: each goes to the nearest block above that it continues."""
    lines = list(lines)
    made: list[Block] = []
    live: list[Block] = []
    down = all(a.y <= b.y for a, b in zip(lines, lines[1:], strict=False))
    reach = max([6.0, *(x.font for x in lines)]) * 1.05 if down else float("inf")
    for line in lines:
        live = [b for b in live if line.y - b.lines[-1].bottom <= reach]  # no later line is nearer
        fits = [b for b in live if continues(b, line, page_width)]
        if fits:
            min(fits, key=lambda b: (line.y - b.lines[-1].bottom, abs(line.x - b.lines[-1].x))).add(line)
        else:
            made.append(Block([line]))
            live.append(made[-1])
    return made


def body_size(blocks: list[Block]) -> float:
    """The font size of running text: of blocks with several lines, weighted by their texts; large titles do not count."""
    weight = lambda b: min(WEIGHT[1], max(WEIGHT[0], len(b.text)))
    several = [b for b in blocks if len(b.lines) > 1]
    first = weighted_middle((b.font, weight(b)) for b in several) or (median([b.font for b in blocks]) if blocks else 0) or 10.0
    return weighted_middle((b.font, weight(b)) for b in several if b.font <= first * 1.18) or first


def whole_lines(lines: list[Line]) -> list[Line]:
    """Lines whose fragments on one baseline are one line again, from top to bottom."""
    order = sorted(lines, key=lambda x: (x.baseline, x.x))
    groups: dict[int, list[Line]] = {}
    for n, line in zip(baselines([(x.baseline, x.font) for x in order], *FRAGMENT), order, strict=True):
        groups.setdefault(n, []).append(line)
    out = []
    for g in groups.values():
        g.sort(key=lambda x: x.x)
        text = re.sub(r"\s+", " ", " ".join(x.text for x in g)).strip()
        out.append(Line(text, min(x.x for x in g), max(x.right for x in g), min(x.y for x in g), max(x.bottom for x in g), median([x.baseline for x in g]), median([x.font for x in g]), sum(x.cells for x in g)))
    return sorted(out, key=lambda x: (x.y, x.x))


def _rebuilt(blocks: list[Block], at: Block, members: list[Block]) -> None:
    """The members' lines become the block `at`; the other members go."""
    new = Block(whole_lines([x for m in members for x in m.lines]))
    at.__dict__.update(new.__dict__)
    blocks[:] = [b for b in blocks if b is at or not any(b is m for m in members)]


def joined_headings(blocks: list[Block], body: float, page_width: float) -> None:
    """Pairs of neighbouring large blocks become one heading."""
    gone: set[int] = set()
    order = sorted(blocks, key=lambda b: b.place)
    for a, b in zip(order, order[1:], strict=False):
        if id(a) in gone or min(a.font, b.font) < body * 1.28:
            continue
        big, gap = max(a.font, b.font), b.y - a.bottom
        like = big / max(1.0, min(a.font, b.font)) <= 1.35 and abs(a.x - b.x) < big * 1.8 and (a.width > page_width * HEADING_SPANS) == (b.width > page_width * HEADING_SPANS)
        if like and -a.font * 0.3 <= gap <= a.font * 1.5:
            for line in b.lines:
                a.add(line)
            gone.add(id(b))
    blocks[:] = [b for b in blocks if id(b) not in gone]


def joined_titles(blocks: list[Block], body: float, page_width: float) -> None:
    """A title-case block takes the nearest one below it in its half of the page."""
    title = lambda b: not T.own_heading(b.text, len(b.lines)) and T.title_like(b.text, len(b.lines), b.font, body)
    left = lambda b: (b.x + b.right) / 2 < page_width / 2

    def follows(seed: Block, b: Block) -> bool:
        big, small = max(seed.font, b.font), min(seed.font, b.font)
        near = -body * 0.2 <= b.y - seed.bottom <= big * 1.15 and left(b) == left(seed) and big / max(1.0, small) <= 1.12
        return near and (abs(b.x - seed.x) <= seed.font * 4 or shared(seed, b) >= min(seed.width, b.width) * 0.5)

    for seed in sorted(blocks, key=lambda b: b.place):
        if any(seed is b for b in blocks) and title(seed):
            fits = [b for b in blocks if b is not seed and title(b) and follows(seed, b)]
            if fits:
                _rebuilt(blocks, seed, [seed, min(fits, key=lambda b: (b.y, abs(b.x - seed.x)))])


def joined_captions(blocks: list[Block], body: float, page_width: float) -> None:
    """Captions take the pieces that go on with them, the topmost first, until none does or they have MOST_MEMBERS."""

    def goes_on(seed: Block, text: str, rows: list[Line], b: Block) -> bool:
        first = min(b.lines, key=lambda x: (x.y, x.x))
        row = next((x for x in rows if abs(x.baseline - first.baseline) <= max(2.2, seed.font * 0.4)), None)
        panel = bool(PANEL.search(b.text.strip()))
        if T.own_heading(b.text, len(b.lines)) or not seed.font * 0.62 <= b.font <= max(seed.font * 1.18, body * 1.04):
            return False
        # A bare label on the baseline of a long text is that text's label.
        if len(b.lines) > 4 and not (row and (panel or BARE.search(seed.text.strip())) and len(b.lines) <= 12):
            return False
        if row:
            return max(0.0, first.x - row.right, row.x - first.right) <= max(seed.font * 3, page_width * 0.14)
        gap = first.y - rows[-1].bottom
        if not -seed.font * 0.25 <= gap <= max(seed.font * 2.6, body * 1.9):
            return False
        if abs(b.x - seed.x) > page_width * 0.09 and shared(seed, b) < min(seed.width, b.width) * 0.42:
            return False
        value = b.text.strip()
        open_ = not ENDED.search(text) or bool(DANGLING.search(text))
        return gap <= max(seed.font * 1.45, body * 1.12) or panel or bool(re.match("[a-z]", value)) or bool(ACRONYMS.search(value)) or open_

    for seed in sorted((b for b in blocks if T.caption(b.text)), key=lambda b: b.place):
        if not any(seed is b for b in blocks):
            continue
        members, of_table = [seed], T.table_caption(seed.text)
        while len(members) < MOST_MEMBERS:
            rows = whole_lines([x for m in members for x in m.lines])
            text = " ".join(x.text for x in rows).strip()
            free = (b for b in blocks if not any(b is m for m in members) and not T.caption(b.text) and not (of_table and T.grid(b.text, b.cells())))
            nearest = min((b for b in free if goes_on(seed, text, rows, b)), key=lambda b: b.place, default=None)
            if nearest is None:
                break
            members.append(nearest)
        if len(members) > 1:
            _rebuilt(blocks, seed, members)


def split_grids(blocks: list[Block]) -> list[Block]:
    """Captions of tables end where the rows of a table begin; these are a block of their own behind them."""
    out = []
    for b in blocks:
        grid = next((i for i, x in enumerate(b.lines) if i and T.grid(x.text, x.cells)), 0) if T.table_caption(b.text) else 0
        out += [Block(whole_lines(b.lines[:grid])), Block(b.lines[grid:])] if grid else [b]
    return out


def blocks_of(lines: Iterable[tuple], page_width: float) -> list[tuple]:
    """The blocks (BLOCK) of one page's lines (LINE), which stand from top to bottom."""
    made = stacked([Line(*r) for r in lines], page_width)
    body = body_size(made)
    joined_headings(made, body, page_width)
    joined_titles(made, body, page_width)
    joined_captions(made, body, page_width)
    out = []
    for i, b in enumerate(split_grids(made)):
        n = len(b.lines)
        own, section, at = T.own_heading(b.text, n), T.section_level(b.text), [x.baseline for x in b.lines]
        step = median([q - p for p, q in zip(at, at[1:], strict=False)]) if n > 1 else b.font * 1.18
        kind = T.caption(b.text), reference_start(b.text), section if own else 0, section, T.title_like(b.text, n, b.font, body), own
        out.append((i, b.text, b.x, b.y, b.right - b.x, b.bottom - b.y, b.font, step, n, float(body), *kind, at))
    return out


def blocks(lines: DataFrame, page_width: float) -> DataFrame:
    """(doc, page, block, text, x, y, width, height, font, line_height, n_lines, body, caption, reference, level, section,
    title, own, lines) of the lines of pages: lines stacked to blocks, headings and captions joined, grids apart. `body` is the page's body font
    size; caption, reference, level and title say what a block is by its words; lines has their baselines."""
    return folded_groups(lines, PAGE, [F.col("line")], [c.split()[0] for c in LINE.split(", ")], lambda rows: blocks_of(rows, page_width), BLOCK)


def roles(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """blocks with `role` (figure-caption, heading, caption, body, artifact or metadata) and `heading_level` (0 to 3): by
    words first, then by font size against the body's. Below a page's main title, short blocks in the upper third are
    metadata."""
    size, body = F.col("font"), F.col("body")
    role = F.when(F.col("caption"), "figure-caption").when(F.col("reference"), "body").when((F.col("level") > 0) | F.col("title") | (size > body * 1.28), "heading").when(size < body * 0.8, "caption").otherwise("body")
    level = F.when(F.col("level") > 0, F.col("level")).when(F.col("title"), 3).when(size >= body * 1.85, 1).when(size >= body * 1.48, 2).otherwise(3)
    b = blocks.withColumn("role", role).withColumn("heading_level", F.when(F.col("role") == "heading", level).otherwise(0))
    b = b.withColumn("role", F.when(T.is_furniture(F.col("text"), F.col("x"), F.col("x") + F.col("width"), F.col("y"), F.col("width"), page_width, page_height), "artifact").otherwise(F.col("role")))
    main = (F.col("role") == "heading") & (F.col("heading_level") == 1)
    title = F.min(F.when(main, F.struct("y", (F.col("y") + F.col("height")).alias("bottom"), "block"))).over(Window.partitionBy(*PAGE))
    small = (F.col("n_lines") <= 2) & (F.length("text") < 240) & (F.col("y") > F.col("_title.bottom")) & (F.col("y") < page_height * 0.34)
    about = F.coalesce(small & ((F.col("role") == "body") | ((F.col("role") == "heading") & (F.col("heading_level") == 3) & ~F.col("own"))), F.lit(False))
    b = b.withColumn("_title", title).withColumn("_about", about)
    return b.withColumn("role", F.when(F.col("_about"), "metadata").otherwise(F.col("role"))).withColumn("heading_level", F.when(F.col("_about"), 0).otherwise(F.col("heading_level")).cast("int")).drop("_title", "_about")


def page_blocks(tokens: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Blocks with roles of positioned tokens: repeated tokens out, lines, blocks, copies of blocks out, roles."""
    from lectern.operators.layout import without_overlapping_copies, without_repeated_tokens

    own = without_repeated_tokens(tokens) if "ord" in tokens.columns else tokens
    # Blocks are read three times below, and made once.
    made = written(_folded_tokens(own, lambda rows: blocks_of([r[1:] for r in lines_of(rows, page_width)], page_width), BLOCK), "blocks")
    return roles(without_overlapping_copies(made), page_width, page_height)


# --- Recognised pages ------------------------------------------------------------------------------------------------------


def recognised_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of a recogniser's lines (doc, page, text, x, y, width, height in pixels, image_width, image_height, page_width,
    page_height): each is one token that ends its line, scaled to the page, its font size 0.82 of its height."""
    across, down = F.col("page_width") / F.greatest(F.lit(1.0), F.col("image_width")), F.col("page_height") / F.greatest(F.lit(1.0), F.col("image_height"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    x, y = F.greatest(F.lit(0.0), number("x")) * across, F.greatest(F.lit(0.0), number("y")) * down
    width, height = F.greatest(F.lit(1.0), number("width")) * across, F.greatest(F.lit(6.0), number("height")) * down
    font = F.greatest(F.lit(6.0), height * 0.82)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    t = lines.select(*PAGE, text.alias("text"), x.alias("x"), F.greatest(F.lit(1.0), width).alias("width"), (y + height - font * 0.12).alias("baseline"), font.alias("font"), F.lit(True).alias("eol"))
    return t.where("text <> ''").withColumns({"right": F.col("x") + F.col("width"), "y": F.col("baseline") - F.col("font"), "bottom": F.col("baseline") + F.col("font") * 0.12})


def read_across(blocks: DataFrame, page_width: float, page_height: float, first_page: int = 1) -> DataFrame:
    """blocks with `place` (from 1) in the order in which two columns are read: what spans the page above them, the left
    column, the right one, what spans it below. On the first page all down to the last heading of a section in its lower
    half comes first, from top to bottom."""
    b = blocks.withColumns({"_right": F.col("x") + F.col("width"), "_wide": F.col("width") > page_width * SPANS})
    page = Window.partitionBy(*PAGE)
    late = (F.col("role") == "heading") & (F.col("section") >= 2) & (F.col("y") >= page_height * 0.45)
    b = b.withColumn("_late", F.max(F.when(late, F.struct("y", (-F.col("block")).alias("n")))).over(page)).withColumn("_first", F.min(F.when(~F.col("_wide"), F.col("y"))).over(page))
    column = F.when((F.col("x") + F.col("_right")) / 2 < page_width / 2, 1).otherwise(2)
    lead = F.when(F.col("_late").isNull() | (F.col("y") < F.col("_late.y")) | (F.col("block") == -F.col("_late.n")), 0).when(F.col("_wide"), 3).otherwise(column)
    other = F.when(F.col("_first").isNull(), 0).when(~F.col("_wide"), column).when(F.col("y") <= F.col("_first") + F.col("font"), 0).otherwise(3)
    b = b.withColumn("_group", F.when(F.col("page") == first_page, lead).otherwise(other))
    place = F.row_number().over(page.orderBy("_group", "y", "x", "block"))
    return b.withColumn("place", place.cast("long")).drop("_right", "_wide", "_late", "_first", "_group")


def recognised_blocks(lines: DataFrame, page_width: float, page_height: float, first_page: int = 1) -> DataFrame:
    """(doc, page, id, role, source, left, top, right, bottom) of a recogniser's lines: blocks with a Latin letter that say
    something, in reading order, as p001b001 and on."""
    b = read_across(page_blocks(recognised_tokens(lines), page_width, page_height), page_width, page_height, first_page)
    b = b.where(~F.col("role").isin("artifact", "figure-content") & F.col("text").rlike("[A-Za-z]"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("place"))
    box = {"left": F.col("x"), "top": F.col("y"), "right": F.col("x") + F.col("width"), "bottom": F.col("y") + F.col("height")}
    return b.select(*PAGE, F.format_string("p%03db%03d", F.col("page"), n).alias("id"), "role", F.col("text").alias("source"), *[F.round(v, 2).alias(k) for k, v in box.items()])


# --- Regions ----------------------------------------------------------------------------------------------------------------


@dataclass
class Box:
    block: int
    text: str
    x: float
    right: float
    y: float
    bottom: float
    role: str

    @property
    def width(self) -> float:
        return self.right - self.x

    @cached_property
    def narrative(self) -> bool:
        return T.narrative(self.text)

    @property
    def prose(self) -> bool:
        return self.role == "body" and self.narrative

    @property
    def drawn(self) -> bool:
        """Neither prose nor at the edge of what the page says."""
        return self.role not in ("metadata", "caption", "artifact") and not self.narrative


def _part(b: Box, left: float, right: float) -> float:
    return max(0.0, min(right, b.right) - max(left, b.x))


def _beside(boxes: list[Box], top: float, bottom: float, left: float, right: float) -> bool:
    """Whether prose runs beside a column between two heights."""
    return any(b.prose and b.y < bottom and b.bottom > top and _part(b, left, right) < min(right - left, b.width) * 0.16 for b in boxes)


def table_region(caption: Box, boxes: list[Box], width: float, height: float, body: float) -> tuple[float, float, float, float] | None:
    """(x, y, right, bottom) from below a table's caption to the next prose of its column, as wide as what lies there."""
    pad, floor = body * 1.05, height * 0.95
    left, right = max(width * 0.035, caption.x - pad), min(width * 0.965, caption.right + pad)
    column = left, right
    below = [b for b in boxes if b is not caption and b.role != "figure-caption" and b.y >= caption.bottom - body * 0.2]
    prose = [b.y for b in below if b.prose and _part(b, left, right) >= min(right - left, b.width) * 0.2]
    bottom = min(floor, min(prose) - body * 0.55) if prose else floor
    rows = [b for b in below if b.y < bottom and b.drawn]
    if rows:
        left = max(width * 0.025, min([left, *(b.x - pad * 0.45 for b in rows)]))
        right = min(width * 0.975, max([right, *(b.right + pad * 0.45 for b in rows)]))
    top = max(caption.bottom + body * 0.15, caption.y + body)
    span = max(b.right for b in rows) - min(b.x for b in rows) if rows else 0.0
    alone = not _beside(below, top, bottom, *column) and (caption.width >= width * 0.4 or len(caption.text) >= 48)
    if span >= width * 0.58 or alone:
        left, right = min(left, width * 0.025), max(right, width * 0.975)
    if not prose and len(rows) >= 3 and (end := max(b.bottom for b in rows)) < floor - body * 3:
        bottom = min(floor, end + pad * 1.4)
    return (left, top, right, bottom) if right - left >= width * 0.18 and bottom - top >= body * 2.2 else None


def figure_region(caption: Box, boxes: list[Box], width: float, height: float, body: float) -> tuple[float, float, float, float] | None:
    """(x, y, right, bottom) from the prose above a figure's caption, or the head of the page, down to the caption."""
    across = caption.width > width * 0.55
    pad = body * (1.2 if across else 0.8)
    left, right = max(0.0, caption.x - pad), min(width, caption.right + pad)
    if across:
        left, right = max(0.0, min(caption.x - pad, width * 0.045)), min(width, max(caption.right + pad, width * 0.955))
    column, others = (left, right), [b for b in boxes if b is not caption]
    above = [b.bottom for b in others if b.prose and b.bottom < caption.y - body * 0.7 and _part(b, left, right) >= min(right - left, b.width) * 0.22]
    top = max(above) + body * 0.9 if above else max(8.0, min(height * 0.04, body * 5))
    top = max(8.0, min(top, caption.y - body * 3))
    drawn = [b for b in others if b.role != "figure-caption" and b.drawn and b.y < caption.y and b.bottom > top]
    span = max(b.right for b in drawn) - min(b.x for b in drawn) if drawn else 0.0
    alone = not _beside(others, top + body * 0.2, caption.y - body * 0.7, *column) and (caption.width >= width * 0.34 or len(caption.text) >= 48)
    if across or span >= width * 0.58 or alone:
        left, right = min(left, width * 0.045), max(right, width * 0.955)
    elif drawn:
        left, right = max(0.0, min([left, *(b.x - pad * 0.4 for b in drawn)])), min(width, max([right, *(b.right + pad * 0.4 for b in drawn)]))
    bottom = caption.y - body * 0.35
    return (left, top, right, bottom) if right - left >= width * 0.2 and bottom - top >= body * 4 else None


def covered(b: Box, region: tuple[float, float, float, float]) -> bool:
    """Whether a block lies in a region: by its centre, or by much of it."""
    left, top, right, bottom = region
    if left <= (b.x + b.right) / 2 <= right and top <= (b.y + b.bottom) / 2 <= bottom:
        return True
    wide, high = _part(b, left, right), max(0.0, min(bottom, b.bottom) - max(top, b.y))
    tall = b.bottom - b.y
    return wide >= min(right - left, b.width) * 0.42 and high >= min(bottom - top, tall) * 0.42 and wide * high >= max(1.0, b.width * tall) * 0.24


def regions(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """(doc, page, caption, kind, x, y, width, height, members): the figure or table of each caption (a block's number), from
    top to bottom. What lies in a region is its content, and no prose or row for the captions after it."""
    names = ["block", "text", "x", "width", "y", "height", "role", "body"]

    def run(rows: list[tuple]) -> list[tuple]:
        if all(r[6] != "figure-caption" for r in rows):
            return []
        boxes = [Box(block, text, x, x + width, y, y + height, role) for block, text, x, width, y, height, role, _ in rows]
        out = []
        for c in sorted((b for b in boxes if b.role == "figure-caption"), key=lambda b: (b.y, b.x, b.block)):
            table = T.table_caption(c.text)
            found = (table_region if table else figure_region)(c, boxes, page_width, page_height, rows[0][7])
            if found:
                inside = [b for b in boxes if b is not c and b.role != "figure-caption" and covered(b, found)]
                for b in inside:
                    b.role = "figure-content"
                left, top, right, bottom = found
                out.append((c.block, "table" if table else "figure", left, top, right - left, bottom - top, sorted(b.block for b in inside)))
        return out

    own = blocks.select(*PAGE, "block", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height", "body")], "role")
    return folded_groups(own, PAGE, [F.col("block")], names, run, "caption long, kind string, x double, y double, width double, height double, members array<long>")


def with_contents(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks with the role figure-content where a region has them."""
    inside = regions.select(*PAGE, F.explode("members").alias("block")).distinct().withColumn("_in", F.lit(True))
    return blocks.join(inside, [*PAGE, "block"], "left").withColumn("role", F.when(F.col("_in"), "figure-content").otherwise(F.col("role"))).drop("_in")

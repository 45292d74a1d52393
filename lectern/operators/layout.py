"""Positioned tokens and blocks of pages: geometry joins, column bands, reading order, recognised lines, containers.

A block has doc, page, block (its number), x, y, width, height, text; right and bottom follow. All operators work within a page,
which has hundreds of blocks at most, so joins meet by (doc, page)."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.runs import folded_groups

PAGE = ["doc", "page"]
#: Shares of a page's width below which a block can be of a column, and of a gap between columns; points of the
#: least gap; share of blocks that a column has; columns at most; area that makes an overlap; longest list of lines of a page.
NARROW, GAP, LEAST_GAP, SUBSTANTIAL, MOST_BANDS, SAME_AREA, MOST_LINES = 0.72, 0.105, 34.0, 0.06, 4, 0.45, 5000
#: Share of its lines that a copy has in common with its original, and points by which they may differ (fixed values).
SAME_LINES, LINE_NEAR = 0.65, 1.2
#: What is no letter where blocks are compared.
OTHERS = re.compile("[^A-Za-z0-9㐀-鿿]+")


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def edges(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"right": F.col("x") + F.col("width"), "bottom": F.col("y") + F.col("height")})


def token(text: Column, matrix: Column, width: Column, viewport: Column, scale: Column) -> Column:
    """struct of a text item on a page: its place by the product of the transforms, its font size, its box."""
    from lectern.functions.web import affine

    m = affine(viewport, matrix)
    at = lambda i: F.get(m, F.lit(i))
    size, wide = F.greatest(F.lit(6.0), F.hypot(at(2), at(3))), F.greatest(F.lit(1.0), F.abs(width * scale))
    box = F.struct(F.trim(text).alias("text"), at(4).alias("x"), (at(4) + wide).alias("right"), wide.alias("width"), at(5).alias("baseline"), (at(5) - size).alias("y"), (at(5) + size * 0.12).alias("bottom"), size.alias("font"))
    return F.when(F.trim(text) != "", box)


def without_repeated_tokens(tokens: DataFrame) -> DataFrame:
    """Of tokens of equal text, place and width, all rounded to points, the first by `ord`."""
    near = [F.floor(F.col(c) + 0.5) for c in ("x", "baseline", "width")]
    w = Window.partitionBy(*PAGE, "text", *near).orderBy("ord")
    return tokens.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def joined_text(before: Column, after: Column) -> Column:
    """Two lines as one text; a word that a hyphen parts before a small letter is whole again."""
    parted = before.rlike("[-‐‑‒–]$") & after.rlike("^[a-z]")
    return F.when(parted, F.concat(F.left(before, F.length(before) - 1), after)).otherwise(F.concat_ws(" ", before, after))


def _sides(blocks: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    b = edges(blocks)
    return tuple(b.select(*PAGE, *[F.col(c).alias(p + c) for c in names]) for p in ("a_", "b_"))


def _covers(a: tuple, b: tuple) -> bool:
    """Whether block b covers SAME_AREA of block a, or has SAME_LINES of its lines."""
    if None not in a[2:6] and None not in b[2:6]:
        wide = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        high = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        if max(0.0, wide) * max(0.0, high) >= SAME_AREA * max(1.0, a[4] * a[5]):
            return True
    return bool(a[6] and b[6]) and sum(any(abs(y - z) <= LINE_NEAR for z in b[6]) for y in a[6]) >= SAME_LINES * len(a[6])


def copies_of(rows: list[tuple], least: int = 80) -> list[tuple]:
    """(block,) of the overlapping copies among one page's (block, text, x, y, width, height, lines): see
    without_overlapping_copies. Only blocks whose heights or lines meet are compared, and letters are taken of these alone."""
    spans = []
    for i, r in enumerate(rows):
        ends = [*(() if r[3] is None or r[5] is None else (r[3], r[3] + r[5])), *(z + e for z in r[6] or () for e in (-LINE_NEAR, LINE_NEAR))]
        if ends and r[1] is not None and len(r[1]) >= least:
            spans.append((min(ends), max(ends), i))
    spans.sort()
    letters: dict[int, str] = {}

    def of(i: int) -> str:
        if i not in letters:
            letters[i] = OTHERS.sub("", rows[i][1]).lower()
        return letters[i]

    gone: set = set()
    for n, (_, end, i) in enumerate(spans):
        for m in range(n + 1, len(spans)):
            if spans[m][0] > end:
                break
            for j, k in ((i, spans[m][2]), (spans[m][2], i)):
                a, b = rows[j], rows[k]
                if a[0] != b[0] and a[0] not in gone and _covers(a, b) and least <= len(of(j)) <= len(of(k)) and of(j) in of(k):
                    gone.add(a[0])
    return [(k,) for k in gone]


def without_overlapping_copies(blocks: DataFrame, least: int = 80) -> DataFrame:
    """blocks without those whose letters stand in another block of the page that covers SAME_AREA of them, or, where blocks
    have `lines` (baselines), SAME_LINES of whose lines it has, to LINE_NEAR points. Of two blocks of equal letters each
    covers the other, and both go as the rule says. A block without a box covers nothing. Texts are dealt out once, by page."""
    names = ["block", "text", "x", "y", "width", "height", "lines"]
    lines = F.col("lines") if "lines" in blocks.columns else F.lit(None)
    own = blocks.where(F.length("text") >= least).select(*PAGE, "block", "text", *[F.col(c).cast("double").alias(c) for c in names[2:6]], lines.cast("array<double>").alias("lines"))
    gone = folded_groups(own, PAGE, [F.col("block")], names, lambda rows: copies_of(rows, least), f"block {dict(blocks.dtypes)['block']}")
    return blocks.join(gone, [*PAGE, "block"], "left_anti")


def in_region(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, page, block) of blocks whose centre lies in a region of the page, or that share much of it with one."""
    b = edges(blocks)
    r = regions.select(*PAGE, *[F.col(c).alias("r_" + c) for c in ("x", "y", "width", "height")])
    j = b.join(r, PAGE)
    cx, cy = (F.col("x") + F.col("right")) / 2, (F.col("y") + F.col("bottom")) / 2
    inside = cx.between(F.col("r_x"), F.col("r_x") + F.col("r_width")) & cy.between(F.col("r_y"), F.col("r_y") + F.col("r_height"))
    ox, oy = overlap(F.col("x"), F.col("right"), F.col("r_x"), F.col("r_x") + F.col("r_width")), overlap(F.col("y"), F.col("bottom"), F.col("r_y"), F.col("r_y") + F.col("r_height"))
    much = (ox >= 0.42 * F.least("r_width", "width")) & (oy >= 0.42 * F.least("r_height", "height")) & (ox * oy >= 0.24 * F.greatest(F.lit(1.0), F.col("width") * F.col("height")))
    return j.where(inside | much).select(*PAGE, "block").distinct()


def overlay_height(blocks: DataFrame) -> DataFrame:
    """(doc, page, block, room): points that a translation may take: down to the next block below that shares a quarter of
    the smaller width, 3.2 times the block's height at most; its own height and a little where nothing is below."""
    a, b = _sides(blocks, ["block", "x", "right", "y", "width", "height"])
    near = overlap(F.col("a_x"), F.col("a_right"), F.col("b_x"), F.col("b_right")) >= 0.25 * F.least("a_width", "b_width")
    nxt = a.join(b, PAGE).where((F.col("b_y") > F.col("a_y")) & (F.col("a_block") != F.col("b_block")) & near).groupBy(*PAGE, F.col("a_block").alias("block")).agg(F.min("b_y").alias("_next"))
    own = F.greatest(F.col("height") + 3, F.col("height") * 1.05)
    room = F.when(F.col("_next").isNull(), own).otherwise(F.greatest(F.lit(5.0), F.least(F.col("_next") - F.col("y") - 2, F.greatest(own, F.col("height") * 3.2))))
    return blocks.join(nxt, [*PAGE, "block"], "left").select(*PAGE, "block", room.alias("room"))


def _says(text: str) -> Column:
    """Whether a text has two characters or more without the white space around it."""
    return F.length(F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")) >= 2


def bands_of(spans: list[tuple[float, float]], width: float) -> list[tuple[float, float, float, int]]:
    """(centre, left, right, blocks) of columns among spans (x, right): centres in order join the column before while they are
    near its mean; columns of few blocks do not count."""
    rows = sorted((x, r) for x, r in spans if r - x < width * NARROW)
    rows.sort(key=lambda s: s[0] + s[1])
    groups: list[list[tuple[float, float]]] = []
    mean = 0.0
    for x, r in rows:
        c = (x + r) / 2
        if groups and c - mean <= max(LEAST_GAP, width * GAP):
            groups[-1].append((x, r))
            mean += (c - mean) / len(groups[-1])
        else:
            groups.append([(x, r)])
            mean = c
    full = [g for g in groups if len(g) >= max(2, len(rows) * SUBSTANTIAL)][:MOST_BANDS]
    return [(sum(x + r for x, r in g) / 2 / len(g), min(x for x, _ in g), max(r for _, r in g), len(g)) for g in full]


def column_bands(blocks: DataFrame, width: float) -> DataFrame:
    """(doc, page, band, centre, left, right, blocks): the columns of each page."""

    def run(rows: list[tuple]) -> list[tuple]:
        return [(i, *m) for i, m in enumerate(bands_of([(x, x + w) for x, w in rows], width))]

    said = blocks.where(_says("text")).select(*PAGE, "x", "width")
    return folded_groups(said, PAGE, [F.col("x"), F.col("width")], ["x", "width"], run, "band long, centre double, left double, right double, blocks long")


def nearest_band(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc, page, block, band): the column whose centre is nearest to the block's; the first of equals."""
    far = F.abs(F.col("x") + F.col("width") / 2 - F.col("centre"))
    return blocks.join(bands, PAGE).groupBy(*PAGE, "block").agg(F.min(F.struct(far.alias("far"), "band")).alias("m")).select(*PAGE, "block", "m.band")


def column_ratios(pages: DataFrame, bands: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, two, three): shares of a document's pages with two columns or more, and with three."""
    n = bands.groupBy(*PAGE).agg(F.count("*").alias("n"))
    p = pages.join(n, PAGE, "left")
    return p.groupBy(key).agg(F.avg((F.coalesce("n", F.lit(0)) >= 2).cast("double")).alias("two"), F.avg((F.coalesce("n", F.lit(0)) >= 3).cast("double")).alias("three"))


def in_reading_order(blocks: DataFrame, width: float) -> DataFrame:
    """(doc, page, block, place): blocks across the page part it into regions; in a region, columns from left to right, each
    from top to bottom; a page without columns is read from top to bottom."""

    def region(rows: list[dict]) -> list[dict]:
        down = sorted(rows, key=lambda b: (b["y"], b["x"]))
        bands = bands_of([(b["x"], b["x"] + b["width"]) for b in rows if b["said"]], width)
        if len(bands) < 2:
            return down
        near = lambda b: min(range(len(bands)), key=lambda i: abs(b["x"] + b["width"] / 2 - bands[i][0]))
        return sorted(down, key=near)

    def run(rows: list[tuple]) -> list[tuple]:
        rows = [dict(zip(names, r, strict=True)) for r in rows]
        narrow = [b for b in rows if b["width"] < width * NARROW]
        middle = lambda b: b["y"] + b["height"] / 2
        out: list[dict] = []
        if len(bands_of([(b["x"], b["x"] + b["width"]) for b in rows if b["said"]], width)) < 2:
            out = sorted(rows, key=lambda b: (b["y"], b["x"]))
        else:
            top = float("-inf")
            for wide in sorted((b for b in rows if b["width"] >= width * NARROW), key=lambda b: (b["y"], b["x"])):
                out += region([b for b in narrow if top <= middle(b) < middle(wide)]) + [wide]
                top = max(top, middle(wide))
            out += region([b for b in narrow if middle(b) >= top])
        return [(b["block"], i + 1) for i, b in enumerate(out)]

    # Of a text, only whether it says something goes to the fold.
    names = ["block", "x", "y", "width", "height", "said"]
    own = blocks.select(*PAGE, "block", "x", "y", "width", "height", F.coalesce(_says("text"), F.lit(False)).alias("said"))
    return folded_groups(own, PAGE, [F.col("block")], names, run, "block long, place long")


def recognised_lines(found: DataFrame, least: float = 0.45) -> DataFrame:
    """Lines of a recogniser (doc, page, ord, text, score, left, top, right, bottom, page_width, page_height), as boxes within
    the page: blank ones, unsure ones and empty boxes go; at most MOST_LINES a page in the order found, as the rule says;
    then from top to bottom."""
    least = min(0.95, max(0.1, least))
    f = found.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where((F.col("text") != "") & (F.col("score") >= least))
    f = f.withColumns({"left": F.greatest(F.lit(0.0), "left"), "top": F.greatest(F.lit(0.0), "top"), "right": F.least("page_width", "right"), "bottom": F.least("page_height", "bottom")}).where("right > left and bottom > top")
    f = f.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))).where(F.col("_n") <= MOST_LINES)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.round("top", 2), F.round("left", 2), "ord"))
    return f.select(*PAGE, place.cast("long").alias("place"), "text", F.round("score", 4).alias("score"), F.round("left", 2).alias("x"), F.round("top", 2).alias("y"), F.round(F.col("right") - F.col("left"), 2).alias("width"), F.round(F.col("bottom") - F.col("top"), 2).alias("height"))


def block_ids(blocks: DataFrame) -> DataFrame:
    """(id, blocks' fields): p001b001 for those with a letter and two characters or more."""
    kept = blocks.where((F.length(F.trim("text")) >= 2) & F.col("text").rlike(r"(?U)\p{L}"))
    return kept.withColumn("id", F.format_string("p%03db%03d", F.col("page") + 1, F.col("block") + 1))


def container(content: Column) -> Column:
    """The container of media bytes by their first ones: mov, wav, flac, ogg, matroska, mp3; null for others."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when((F.length(content) >= 12) & (F.substring(h, 9, 8) == "66747970"), "mov")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav")
        .when(h.startswith("664C6143"), "flac")
        .when(h.startswith("4F676753"), "ogg")
        .when(h.startswith("1A45DFA3"), "matroska")
        .when(h.startswith("494433") | ((F.length(content) > 2) & h.rlike("^FF[EF]")), "mp3")
    )

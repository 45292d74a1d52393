"""Runs of ordered rows that a rule on a running state cuts: batches, units of translation, and their way back.

A run is found by reading a key's rows in order, batch by batch, with a few numbers of state: no array per key is built, and
a key of any length takes constant memory. Partitions are hashed by key and sorted, so rows are shuffled once."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Cues and characters of a batch, seconds of pause and of span, characters from which a sentence's end closes it.
CUES, CHARS, PAUSE, SPAN, FULL = 24, 4000, 2.0, 45.0, 500
SENTENCE_END = r"[.!?。！？][\"'”’)]?$"


def numbered_runs(rows: DataFrame, key: str, order: list[str], fields: dict[str, Column], goes_on: Callable[[tuple, tuple], tuple | None], begin: Callable[[tuple], tuple], name: str = "run") -> DataFrame:
    """(key, order, name): the number of its run (from 0) for each row, in the order of `order`. goes_on(state, row of fields)
    gives the next state, or None where a new run begins; begin(row) is the state after a run's first row."""
    kinds = dict(rows.dtypes)
    columns = [f"_f_{n}" for n in fields]
    own = rows.select(key, *order, *[c.alias(f"_f_{n}") for n, c in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, n = None, None, 0
        for b in batches:
            ks = b.column(0).to_pylist()
            out = []
            for k, row in zip(ks, zip(*[b.column(f).to_pylist() for f in columns], strict=True), strict=True):
                if state is None or k != held:
                    held, state, n = k, begin(row), 0
                else:
                    new = goes_on(state, row)
                    n, state = (n + 1, begin(row)) if new is None else (n, new)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, *order)], pa.array(out, pa.int64())], names=[key, *order, name])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order)) + f", `{name}` long"
    return own.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def greedy_batches(rows: DataFrame, key: str, order: str, size: Column, max_items: int, max_size: int) -> DataFrame:
    """(key, order, batch): items in order, a new batch where an item would exceed either limit. Texts never enter the fold;
    an item over the limit has a batch of its own."""
    return numbered_runs(rows, key, [order], {"size": F.coalesce(size, F.lit(0))}, lambda s, r: None if s[0] >= max_items or s[1] + r[0] > max_size else (s[0] + 1, s[1] + r[0]), lambda r: (1, r[0]), "batch")


def cue_batches(segments: DataFrame, key: str, order: str, source: str = "source", start: str = "start", end: str = "end") -> DataFrame:
    """(key, order, batch) of segments that go to a model together: up to CUES and CHARS, without a pause of PAUSE seconds or
    more than SPAN seconds in all, and closed by a sentence's end once they have FULL characters."""
    text = F.coalesce(F.col(source), F.lit(""))
    fields = {"chars": F.length(text), "start": F.col(start).cast("double"), "end": F.col(end).cast("double"), "ends": text.rlike(SENTENCE_END)}

    def closes(chars: int, ends: bool) -> bool:
        return chars >= FULL and ends

    def goes_on(s: tuple, r: tuple) -> tuple | None:
        n, chars, first, last, closed = s
        if closed or n >= CUES or chars + r[0] > CHARS or r[1] - last >= PAUSE or r[2] - first > SPAN:
            return None
        return n + 1, chars + r[0], first, r[2], closes(chars + r[0], r[3])

    return numbered_runs(segments, key, [order], fields, goes_on, lambda r: (1, r[0], r[1], r[2], closes(r[0], r[3])), "batch")


#: Pages or other keys whose rows go out as one batch.
KEYS_PER_BATCH = 256


def _batches_of(schema: str) -> Callable[[list[tuple]], pa.RecordBatch]:
    """Rows as a batch of a schema."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def made(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found, strict=True) if found else [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return made


def folded_groups(rows: DataFrame, keys: list[str], order: list[Column], fields: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(keys, schema): what run(rows of fields) makes of each key's rows, in the order of `order`. Partitions are hashed by key
    and sorted, and read batch by batch; a key costs its rows as tuples, and no frame of its own."""
    kinds = dict(rows.dtypes)
    whole = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema
    made = _batches_of(whole)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, found, n = None, [], [], 0
        for b in batches:
            key_of = zip(*[b.column(k).to_pylist() for k in keys], strict=True)
            for k, row in zip(key_of, zip(*[b.column(c).to_pylist() for c in fields], strict=True), strict=True):
                if group and k != held:
                    found += [(*held, *x) for x in run(group)]
                    group, n = [], n + 1
                    if n == KEYS_PER_BATCH:
                        yield made(found)
                        found, n = [], 0
                held = k
                group.append(row)
        if group:
            found += [(*held, *x) for x in run(group)]
        yield made(found)

    own = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return own.select(*keys, *fields).mapInArrow(go, whole)


def folded_within(rows: DataFrame, key: str, field: str, groups: Callable[[object], Iterable[tuple]], run: Callable[[list[tuple]], list[tuple]], name: str, schema: str) -> DataFrame:
    """(key, name, schema): what run makes of each group of rows that groups(field) finds within a row, as (name, rows in
    order); name is a long. A row holds its groups whole, so nothing is shuffled, sorted or written for them, and one group
    at a time is held beside the batch that was read."""
    made = _batches_of(f"`{key}` {dict(rows.dtypes)[key]}, `{name}` long, {schema}")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            for k, v in zip(b.column(0), b.column(1), strict=True):
                k = k.as_py()
                for g, group in groups(v.as_py()):
                    found += [(k, g, *x) for x in run(group)]
                    n += 1
                    if n == KEYS_PER_BATCH:
                        yield made(found)
                        found, n = [], 0
        yield made(found)

    return rows.select(key, field).mapInArrow(go, f"`{key}` {dict(rows.dtypes)[key]}, `{name}` long, {schema}")


# --- Units of translation -----------------------------------------------------------------------------------------------------

#: Fixed values by class of document: whether units cross pages, and characters of a unit.
UNITS = {"academic-paper": (True, 2600), "research-report": (True, 2300), "newspaper": (False, 1700), "magazine": (False, 1900), "book": (True, 2800), "generic": (False, 2200)}
#: Roles that are units of their own, ends of sentences, headings, and beginnings of what goes on over a page (fixed values).
APART = ("heading", "figure-caption", "caption", "metadata", "reference")
TERMINAL = r"[.!?。！？;；:：”’\])}]$"
REFERENCES = r"(?i)^(?:references|bibliography|参考文献)\b"
HEADINGS = (r"^[A-Z][A-Z\s\d&-]{4,}$", r"^\d+(?:\.\d+)*\s+\p{Lu}")
ACROSS = "^[a-z(\\[“‘]"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def translation_units(blocks: DataFrame, place: str = "place", kind: Column | None = None) -> DataFrame:
    """(doc, unit, page, pages, blocks, members, text, role) of blocks (doc, page, block, place in the document's reading order,
    x, width, text, role, and if there: preserve): a block goes on with the one before unless it stands apart, ends a
    sentence, lies in another column, or the unit gets too long; over a page only where the class of document (`kind`, a
    column; generic if none) allows it and the text goes on in lower case. blocks and members are their numbers and texts."""
    of = kind if kind is not None else F.lit("generic")
    rule = lambda i: F.coalesce(*[F.when(of == k, F.lit(v[i])) for k, v in UNITS.items()], F.lit(UNITS["generic"][i]))
    w = Window.partitionBy("doc").orderBy(place)
    preserve = F.coalesce(F.col("preserve"), F.lit(False)) if "preserve" in blocks.columns else F.lit(False)
    b = blocks.withColumns({"_t": plain(F.col("text")), "_across": rule(0), "_most": rule(1)})
    b = b.withColumn("_apart", F.coalesce(F.col("role").isin(*APART), F.lit(False)) | preserve | F.col("_t").rlike(REFERENCES))
    before = {c: F.lag(c).over(w) for c in ("_t", "_apart", "page", "x", "width")}
    b = b.withColumns({f"_b{c}": v for c, v in before.items()})
    crossed = F.col("_bpage") != F.col("page")
    near = F.abs(F.coalesce("_bx", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))) <= F.greatest(F.lit(58.0), F.least(F.coalesce("_bwidth", F.lit(0.0)), F.coalesce("width", F.lit(0.0))) * 0.55)
    head = F.col("_t").rlike(HEADINGS[0]) | F.col("_t").rlike(HEADINGS[1])
    texts = (F.col("_t") != "") & (F.col("_b_t") != "") & (F.length("_t") + F.length("_b_t") <= F.col("_most"))
    place_ok = F.when(crossed, F.col("_across") & F.col("_t").rlike(ACROSS)).otherwise(near)
    joins = F.coalesce(~F.col("_apart") & ~F.col("_b_apart") & texts & ~F.col("_b_t").rlike(TERMINAL) & ~head & place_ok, F.lit(False))
    b = b.withColumn("_joins", joins)
    fields = {"joins": F.col("_joins"), "chars": F.length("_t"), "most": F.col("_most")}
    unit = numbered_runs(b, "doc", [place], fields, lambda s, r: s + r[1] + 1 if r[0] and s + r[1] + 1 <= r[2] else None, lambda r: r[1], "unit")
    each = F.array_sort(F.collect_list(F.struct(place, "page", "block", "_t", "role")))
    u = b.join(unit, ["doc", place]).groupBy("doc", "unit").agg(each.alias("m"))
    get = lambda c: F.transform("m", lambda x: x[c])
    return u.select("doc", "unit", F.get("m", 0)["page"].alias("page"), F.array_distinct(get("page")).alias("pages"), get("block").alias("blocks"), get("_t").alias("members"), F.array_join(get("_t"), " ").alias("text"), F.coalesce(F.get("m", 0)["role"], F.lit("body")).alias("role"))


def divided(text: Column, members: Column) -> Column:
    """A unit's translation as one part for each member: sentences go to the members in order, on to the next once its share
    of the source's characters is used up; if that leaves a member without text, by shares of characters alone."""
    n, whole = F.size(members), F.length(text).cast("double")
    lengths = F.transform(members, lambda m: F.length(m))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    share = F.when(total > 0, total).otherwise(n)
    upto = F.transform(members, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) / share * whole)
    sentences = F.filter(F.regexp_extract_all(text, F.lit(r"[^。！？.!?]+[。！？.!?]?\s*"), F.lit(0)), lambda s: F.trim(s) != "")
    sentences = F.when(F.size(sentences) > 0, sentences).otherwise(F.array(text))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.array().cast("array<struct<at:int,s:string>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        at = F.when((a["at"] < n - 1) & (a["used"] >= F.get(upto, a["at"])), a["at"] + 1).otherwise(a["at"])
        return F.struct(at.alias("at"), (a["used"] + F.length(s)).alias("used"), F.concat(a["out"], F.array(F.struct(at.alias("at"), s.alias("s")))).alias("out"))

    dealt = F.aggregate(sentences, begin, step, lambda a: a["out"])
    parts = F.transform(members, lambda _, i: F.trim(F.array_join(F.transform(F.filter(dealt, lambda x: x["at"] == i), lambda x: x["s"]), "")))
    said = F.trim(text)
    size = F.length(said)
    edge = lambda i: F.floor(F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x) / share * size + 0.5).cast("int")

    def cut(_: Column, i: Column) -> Column:
        start, end = edge(i), F.when(i == n - 1, size).otherwise(edge(i + 1))
        piece = F.trim(F.substr(said, start + 1, F.greatest(start + 1, end) - start))
        return F.when(piece == "", "…").otherwise(piece)

    whole_parts = F.forall(parts, lambda p: p != "")
    return F.when(n <= 1, F.array(text)).when(whole_parts, parts).otherwise(F.transform(members, cut))


def with_translations(units: DataFrame, translated: DataFrame) -> DataFrame:
    """(doc, unit, block, translation, anchor) of the blocks of units that have a translation (doc, unit, translation); the
    first block of a unit is its anchor. Blank translations give none."""
    t = translated.select("doc", "unit", plain(F.col("translation")).alias("_said")).where("_said <> ''")
    d = units.join(t, ["doc", "unit"]).select("doc", "unit", "blocks", divided(F.col("_said"), F.col("members")).alias("parts"))
    return d.select("doc", "unit", F.posexplode(F.arrays_zip("blocks", "parts")).alias("i", "x")).select("doc", "unit", F.col("x.blocks").alias("block"), F.col("x.parts").alias("translation"), (F.col("i") == 0).alias("anchor"))

"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

A conversation is in order if the first letters of its roles read `(s?(ua)+)?`. Turns can be kept, given another role,
deleted, and inserted empty. The lattice of all edits has a node for each (turn index, state of the grammar) and is never
built: Dijkstra's search with the priority (cost, audit) makes a node's edges when it is popped, and stops at the first
popped node behind the last turn whose state accepts. The audit is the sequence of edits by their first letters; it decides
between equal costs, and since it also fixes the path, no audit at a node is the beginning of another of equal cost.

Conversations are put together by one shuffle and read in order from sorted partitions, batch by batch. One of over ROWS
turns or BYTES of text is never held by a task: its turns get their places by range partitioning, blocks of ROWS places
are searched apart from each state of the grammar to each, and the results are composed as (min, +) matrices with their
audits. Which turns are duplicates is settled by an aggregation of hashes. Only the digest of its repaired text is taken by
one task, which reads it in order and holds one batch. The way that is taken changes no result.

Defined results: a null role, text, id or turn reads as one space where it is rendered; a null turn comes first; turns of
one number stand in order of role and text; repeated rows are duplicates; roles of other first letters than s, u, a fit
nowhere; conversations without an id are one conversation; texts of any length are read whole; other columns, whatever
their names, are ignored; a conversation that damage leaves without rows has zeros, an empty audit and the digest of the
empty text; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SMALL_ROWS, SPACES, written
from lectern.operators.numbering import number_rows

#: Turns and bytes of text of a conversation that one task holds; turns of a block of a longer one.
ROWS, BYTES = 2_000, 64 << 20
#: States of the grammar by the last role, the states that accept, and the role that comes next.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTS = (START, ASSISTANT)
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {"user": USER, "assistant": ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: Costs of edits, and of a truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Faults of a turn; the first that holds counts.
FINE, BLANK, DUPLICATE, CUT = range(4)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, there): rows with seeded faults, by a hash of `conv:turn` modulo 20: 0 drops the row (it
    stays with `there` false), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    own = _own(rows, conv, turn, role, text)
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    own = own.withColumn("_do", F.crc32(name) % 20)
    text = F.when(F.col("_do") == 1, "").when(F.col("_do") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_do") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_do") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("_do") != 0).alias("there"), copies.alias("_copy")).drop("_copy")


def _own(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), named(role).alias("role"), named(text).alias("text"))


def _edges() -> list[list[list[tuple[int, str, int]]]]:
    """For each turn's code (first letter s, u, a or other, times fault) and each state: (cost, edit, next state)."""
    out = []
    for letter in "sua ":
        for fault in (FINE, BLANK, DUPLICATE, CUT):
            extra = TRUNCATED if fault == CUT else 0
            states = []
            for state in (START, SYSTEM, USER, ASSISTANT):
                edges = [(DELETE, "D", state)]
                if fault not in (BLANK, DUPLICATE):
                    after = AFTER[NEXT[state]]
                    edges.append((REROLE + extra, "R", after))
                    if letter == NEXT[state][0]:
                        edges.append((extra, "K", after))
                    elif letter == "s" and state == START:
                        edges.append((extra, "K", SYSTEM))
                states.append(edges)
            out.append(states)
    return out


EDGES = _edges()


def code(letter: str, fault: int) -> int:
    """A turn as the search sees it."""
    return 4 * ("sua".index(letter) if letter in ("s", "u", "a") else 3) + fault


def cheapest(codes: list[int], state: int = START) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state) behind the last turn, in order of (cost, audit), for each state that can be reached: Dijkstra's
    search over (index, state) from the given state before the first turn."""
    last, done = len(codes), set()
    heap = [(0, "", 0, state)]
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == last:
            yield cost, audit, state
        else:
            for c, edit, after in EDGES[codes[i]][state]:
                if (i + 1, after) not in done:
                    heappush(heap, (cost + c, audit + edit, i + 1, after))
        after = AFTER[NEXT[state]]
        if (i, after) not in done:
            heappush(heap, (cost + INSERT, audit + "I", i, after))


def repaired(turns: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each turn that an audit leaves or inserts."""
    turns = iter(turns)
    for edit in audit:
        role, text = (NEXT[state], "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "R":
            role = NEXT[state]
        state = SYSTEM if state == START and edit == "K" and role[:1] == "s" else AFTER[NEXT[state]]
        yield role, text, edit


def fault_of(text: str, again: bool) -> int:
    """The first fault of a turn; `again`: role and text were seen earlier in its conversation."""
    full = text.rstrip(SPACES)
    return BLANK if not full else DUPLICATE if again else FINE if full[-1] in ".!?" else CUT


def gaps_of(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def _signed(n: int) -> int:
    """n as a long that wraps around, as Spark's do."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _whole(turns: list[tuple[int | None, str, str]]) -> tuple[list[int], str]:
    """([gaps, blank, duplicate, truncated, illegal, cost], audit) of a conversation that is held."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in turns:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    letters = [r[:1] for _, r, _ in turns]
    cost, audit = next((c, a) for c, a, s in cheapest([code(x, f) for x, f in zip(letters, faults, strict=True)]) if s in ACCEPTS)
    illegal = sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False))
    return [_signed(gaps_of([t for t, _, _ in turns if t is not None])), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost], audit


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _groups(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows of equal key, across batches."""
    held, name = [], None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in b.schema.names]
        keys = zip(*[cols[b.schema.names.index(k)] for k in key], strict=True)
        for k, row in zip(keys, zip(*cols, strict=True), strict=True):
            if held and k != name:
                yield name, held
                held = []
            name = k
            held.append(row)
    if held:
        yield name, held


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _hashed(turns: Iterable[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text, _ in turns).encode()).hexdigest()


def compose(a: dict, b: dict) -> dict:
    """Paths through two neighbouring blocks from paths through each: {(state before, after): (cost, audit, marks)}; marks
    note the state before each block and its edits' number."""
    out: dict = {}
    for (p, m), (cost, audit, marks) in a.items():
        for q in range(4):
            if (m, q) in b:
                c, x, y = b[m, q]
                new = (cost + c, audit + x, marks + y)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


class Repair:
    """Conversations and their repair. `summary`: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row per conversation. `messages`: (conv, block, place, role, text, edit), the repaired turns."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False):
        self.name = conv
        own = damaged(rows, conv, turn, role, text) if damage else _own(rows, conv, turn, role, text).withColumn("there", F.lit(True))
        self.kind = own.schema["conv"].dataType.simpleString()
        sizes = own.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
        long = written(sizes.where((F.col("n") > ROWS) | (F.col("b") > BYTES)).select(F.col("conv").alias("_long"), F.lit(True).alias("_is")), "long")
        known = long.count()
        if known:
            apart = own.join(F.broadcast(long) if known <= SMALL_ROWS else long, F.col("conv").eqNullSafe(F.col("_long")), "left")
            self.short, self.long = apart.where("_is is null").drop("_long", "_is"), apart.where("_is").drop("_long", "_is")
            self.blocks, self.turns = self._in_blocks()
        else:
            self.short, self.long = own, None
        # One shuffle; sorted partitions put each conversation's turns together in order.
        self.short = self.short.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")

    def summary(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = None

            def rows() -> Iterator[tuple]:
                for (conv,), got in _groups(each, ["conv"]):
                    turns = [(t, r, x) for _, t, r, x, there in got if there]
                    counts, audit = _whole(turns)
                    yield conv, *counts, audit, _hashed(repaired(((r, x) for _, r, x in turns), audit))

            first = next(batches, None)
            if first is not None:
                each = _chained(first, batches)
                schema = pa.schema([("conv", first.schema.field("conv").type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
                yield from _batches(rows(), schema)

        out = self.short.mapInArrow(run, f"conv {self.kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
        if self.long is not None:
            out = out.unionByName(self._long_summary())
        return out.withColumnRenamed("conv", self.name)

    def messages(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for (conv,), got in _groups(each, ["conv"]):
                    turns = [(t, r, x) for _, t, r, x, there in got if there]
                    for place, m in enumerate(repaired(((r, x) for _, r, x in turns), _whole(turns)[1])):
                        yield conv, 0, place, *m

            first = next(batches, None)
            if first is not None:
                each = _chained(first, batches)
                yield from _batches(rows(), _messages_schema(first.schema.field("conv").type))

        out = self.short.mapInArrow(run, self._messages_ddl())
        if self.long is not None:
            out = out.unionByName(self._long_messages())
        return out.withColumnRenamed("conv", self.name)

    def _messages_ddl(self) -> str:
        return f"conv {self.kind}, block long, place long, role string, text string, edit string"

    def _in_blocks(self) -> tuple[DataFrame, DataFrame]:
        """(repair of each block, turns with places) of the long conversations, both as tables."""
        kind = self.kind
        # The row's place in the input parts equal rows, so that ranges can.
        there = self.long.where("there").drop("there").withColumn("_row", F.monotonically_increasing_id())
        turns = number_rows(there, ["conv", "turn", "role", "text", "_row"], "pos", 0).drop("_row").withColumn("block", F.floor(F.col("pos") / ROWS))
        turns = written(turns, "turns")
        # A turn is a duplicate unless it is the first of its role and text; firsts are joined by place, which is even.
        firsts = turns.groupBy("conv", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("h")).agg(F.min("pos").alias("_first")).select("_first")
        full = F.rtrim("text", F.lit(SPACES))
        marked = turns.select("conv", "block", "pos", F.substring("role", 1, 1).alias("letter"), F.when(full == "", BLANK).when(F.substring(full, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT).alias("own"))
        marked = marked.join(firsts, marked["pos"] == firsts["_first"], "left").select("conv", "block", "pos", "letter", F.when((F.col("own") != BLANK) & F.col("_first").isNull(), DUPLICATE).otherwise(F.col("own")).alias("fault"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for (conv, block), got in _groups(each, ["conv", "block"]):
                    letters, faults = [r[3] for r in got], [r[4] for r in got]
                    codes = [code(x, f) for x, f in zip(letters, faults, strict=True)]
                    paths = [(p, q, c, a) for p in range(4) for c, a, q in cheapest(codes, p)]
                    illegal = sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False))
                    yield conv, block, letters[0], letters[-1], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, [{"p": p, "q": q, "c": c, "a": a} for p, q, c, a in paths]

            first = next(batches, None)
            if first is not None:
                each = _chained(first, batches)
                path = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("c", pa.int64()), ("a", pa.string())]))
                schema = pa.schema([("conv", first.schema.field("conv").type), ("block", pa.int64()), ("head", pa.string()), ("tail", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("paths", path)])
                yield from _batches(rows(), schema, 20)

        ddl = f"conv {kind}, block long, head string, tail string, blank long, duplicate long, truncated long, illegal long, paths array<struct<p:int,q:int,c:long,a:string>>"
        found = marked.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInArrow(search, ddl)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                name, state = object(), None
                for b in each:
                    for r in b.to_pylist():
                        if r["conv"] != name or state is None:
                            if state is not None:
                                yield from state.rows()
                            name, state = r["conv"], _Chain(r["conv"])
                        state.add(r)
                if state is not None:
                    yield from state.rows()

            first = next(batches, None)
            if first is not None:
                each = _chained(first, batches)
                schema = pa.schema([("conv", first.schema.field("conv").type), ("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), *[(c, pa.int64()) for c in COUNTS[1:]]])
                yield from _batches(rows(), schema, 50)

        blocks = found.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(join, f"conv {kind}, block long, state int, edits string, " + ", ".join(f"{c} long" for c in COUNTS[1:]))
        return written(blocks, "blocks"), turns

    def _long_messages(self) -> DataFrame:
        def run(key: tuple, turns: pa.Table, edits: pa.Table) -> pa.Table:
            turns = turns.sort_by("pos")
            audit, state = edits.column("edits")[0].as_py(), edits.column("state")[0].as_py()
            got = list(repaired(zip(turns.column("role").to_pylist(), turns.column("text").to_pylist(), strict=True), audit, state))
            schema = _messages_schema(turns.schema.field("conv").type)
            cols = list(zip(*got, strict=True)) if got else [(), (), ()]
            n = len(got)
            return pa.table([pa.array([key[0].as_py() if n else None] * n, schema[0].type), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), *[pa.array(c, pa.string()) for c in cols]], schema=schema)

        return self.turns.groupBy("conv", "block").cogroup(self.blocks.groupBy("conv", "block")).applyInArrow(run, self._messages_ddl())

    def _long_summary(self) -> DataFrame:
        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                name, h = None, None
                for b in each:
                    for conv, role, text in zip(*[b.column(c).to_pylist() for c in ("conv", "role", "text")], strict=True):
                        if h is None or conv != name:
                            if h is not None:
                                yield name, h.hexdigest()
                            name, h = conv, hashlib.sha256()
                            h.update(f"{role}:{text}".encode())
                        else:
                            h.update(f"\n{role}:{text}".encode())
                if h is not None:
                    yield name, h.hexdigest()

            first = next(batches, None)
            if first is not None:
                each = _chained(first, batches)
                yield from _batches(rows(), pa.schema([("conv", first.schema.field("conv").type), ("_sha", pa.string())]))

        sha = self._long_messages().repartition("conv").sortWithinPartitions("conv", "block", "place").mapInArrow(digest, f"conv {self.kind}, _sha string").withColumnRenamed("conv", "_b")
        numbers = self.turns.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
        done = self.blocks.groupBy("conv").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS[1:]], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("audit"))
        ids = self.long.select(F.col("conv").alias("_id")).distinct()
        out = ids.join(done, F.col("_id").eqNullSafe(F.col("conv")), "left").drop("conv")
        out = out.join(numbers, F.col("_id").eqNullSafe(F.col("conv")), "left").drop("conv").join(sha, F.col("_id").eqNullSafe(F.col("_b")), "left").drop("_b")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return out.select(F.col("_id").alias("conv"), *[zero(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("_sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


class _Chain:
    """Blocks of one conversation, composed in a balanced way as they come: audits of n edits are copied log n times."""

    def __init__(self, conv):
        self.conv, self.stack, self.blocks = conv, [], []
        self.tail, self.counts = None, []

    def add(self, r: dict) -> None:
        across = int(self.tail is not None and self.tail + r["head"] not in LEGAL)
        self.tail = r["tail"]
        self.blocks.append(r["block"])
        self.counts.append([r["blank"], r["duplicate"], r["truncated"], r["illegal"] + across])
        paths, n = {(x["p"], x["q"]): (x["c"], x["a"], ((x["p"], len(x["a"]), x["c"]),)) for x in r["paths"]}, 1
        while self.stack and self.stack[-1][1] == n:
            before, n = self.stack.pop()[0], 2 * n
            paths = compose(before, paths)
        self.stack.append((paths, n))

    def rows(self) -> Iterator[tuple]:
        paths = self.stack.pop()[0]
        while self.stack:
            paths = compose(self.stack.pop()[0], paths)
        _, audit, marks = min(paths[START, q] for q in ACCEPTS if (START, q) in paths)
        at = 0
        for block, counts, (state, n, cost) in zip(self.blocks, self.counts, marks, strict=True):
            yield self.conv, block, state, audit[at : at + n], *counts, cost
            at += n


def _chained(first: pa.RecordBatch, rest: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _messages_schema(conv: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", conv), ("block", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def repair_conversations(rows: DataFrame, **names) -> DataFrame:
    """The summary of the repair of each conversation; see Repair for the names of columns and for the repaired turns."""
    return Repair(rows, **names).summary()

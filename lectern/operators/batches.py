"""Batches of texts that a model answers badly: an iterative work list of DataFrames that halves, retries and falls back.

A round asks for all open requests at once, one row each, in Arrow batches; its answers are a table before they are judged,
so nothing is asked twice if an executor is lost. A request whose answer cannot be read is halved; one that lacks answers,
or has texts that came back untranslated, asks for these again; what is left of a single text goes through plain stages.
Every text keeps the best that it got, and a log of its stages. After DEPTH rounds a request that still fails ends, so there
are DEPTH + 1 rounds and three stages at most, whatever the number of batches; a request is no larger than its batch was.

Defined results: an answer to an id that was not asked for is ignored; of several answers to one id the last counts; blank
answers are none; a list of plain strings counts only if it has the right length; an empty table gives an empty table. An
error of the service itself (a status of 400 or more) ends the whole batch, and none of its texts is translated."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.functions import quality as Q
from lectern.functions.normal import normal_source_of
from lectern.functions.split import chunks
from lectern.operators.checks import RETRYABLE
from lectern.shared import written

#: Rounds after the first for requests in general, and for texts that come back untranslated (fixed values).
DEPTH, UNTRANSLATED_DEPTH = 4, 2
#: Chunks from which a text is asked for in chunks first; characters of a message that the log keeps (fixed values).
CHUNKED_FIRST, MESSAGE = 3, 240
#: Requests that are held as objects of Python at a time.
SLICE = 64
ATTEMPT = "struct<stage:string,status:int,code:string,message:string>"


class Reply(NamedTuple):
    """A model's answer: (id, text) pairs with ids t0, t1, ..., or a dict of them, or one string for each text; None if it
    cannot be read."""

    answers: list | dict | None = None
    status: int = 200
    message: str = ""


#: Asks for several texts at once; `depth` is the round.
Ask = Callable[[list[str], int], Reply]
#: Asks for one text in a mode: normal, forced or forced-chunk; answers is a string.
AskPlain = Callable[[str, str], Reply]


def aligned(answers: list | dict, n: int) -> list[str]:
    """Answers in the order of the texts asked for; "" where there is none."""
    if isinstance(answers, dict):
        pairs = list(answers.items())
    elif all(isinstance(a, str) for a in answers):
        return list(answers) if len(answers) == n else [""] * n
    else:
        pairs = [a for a in answers if isinstance(a, (tuple, list)) and len(a) == 2]
    out = [""] * n
    for name, text in pairs:
        m = re.fullmatch("t([0-9]+)", str(name))
        if m and int(m[1]) < n and isinstance(text, str) and text.strip():
            out[int(m[1])] = text
    return out


def in_slices(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """rows.mapInPandas(run, schema), but only SLICE requests of an Arrow batch are objects of Python at a time."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                for made in run(iter([pd.DataFrame(b.slice(i, SLICE).to_pylist(), columns=b.schema.names, dtype=object)])):
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name].tolist(), f.type) for f in kind], schema=kind)

    return rows.mapInArrow(go, schema)


def untranslated(source: Column, answer: Column, target: str, role: Column) -> Column:
    """Whether an answer is its source again, or lacks the target language; both in their normal forms."""
    return Q.quality(source, answer, F.lit(target), role).isin("source-copy", "target-language-missing")


def translate_batches(rows: DataFrame, ask: Ask, plain: AskPlain, batch: str = "batch", pos: str = "pos", text: str = "text", role: Column | None = None, target: str = "简体中文") -> DataFrame:
    """(batch, pos, translation, ok, code, stage, status, depth, attempts) of rows, whose (batch, pos) are unique: translation
    is "" where a text failed; code and stage then say why and where; depth counts the requests before the last one."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (batch, pos)}
    work = rows.select(F.col(batch).alias("batch"), F.lit("").alias("node"), F.col(pos).alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(role if role is not None else F.lit(""), F.lit("")).alias("role"))
    item = f"struct<pos:{kinds[pos]},text:string,role:string,source:string,answer:string,said:string>"

    def call(depth: int):
        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                out = []
                for items in pdf["items"]:
                    texts = [x["text"] for x in items]
                    r = ask(texts, depth)
                    said = aligned(r.answers, len(texts)) if r.status < 400 and r.answers is not None else [""] * len(texts)
                    out.append((r.status, r.answers is None, str(r.message)[:MESSAGE], [{"pos": x["pos"], "text": x["text"], "role": x["role"], "source": normal_source_of(x["text"]), "answer": a, "said": normal_source_of(a)} for x, a in zip(items, said, strict=True)]))
                pdf[["status", "broken", "message", "items"]] = pd.DataFrame(out, columns=["status", "broken", "message", "items"], index=pdf.index)
                yield pdf[["batch", "node", "status", "broken", "message", "items"]]

        return run

    done, failed, single, fatal = [], [], [], []
    empty = F.array().cast(f"array<{ATTEMPT}>")
    for depth in range(DEPTH + 1):
        requests = work.groupBy("batch", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "role"))).alias("items"))
        answered = in_slices(requests, call(depth), f"batch {kinds[batch]}, node string, status int, broken boolean, message string, items array<{item}>")
        answered = written(answered, "answers")
        bad = lambda x: (x["answer"] != "") & untranslated(x["source"], x["said"], target, x["role"])
        as_heard = lambda x: F.when(bad(x), "").when((x["answer"] == "") & Q.source_preserving(x["source"], x["role"]), x["text"]).otherwise(x["answer"])
        judge = lambda answer, lost: F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "text", "role", "source")], answer(x).alias("answer"), lost(x).alias("bad")))
        heard = F.when(F.col("broken"), judge(lambda x: F.lit(""), lambda x: F.lit(False))).otherwise(judge(as_heard, bad))
        j = answered.where("status < 400").withColumn("n", F.size("items")).withColumn("items", heard)
        missing = F.filter("items", lambda x: x["answer"] == "")
        j = written(j.withColumns({"missing": missing, "bad": F.exists("items", lambda x: x["bad"])}), "judged")
        fatal.append(answered.where("status >= 400").select("batch", "status", "message"))
        some = F.size("missing") > 0
        more = F.lit(depth) < F.when(F.col("bad"), UNTRANSLATED_DEPTH).otherwise(DEPTH)
        alone = F.col("n") == 1
        again = some & more & ~(F.col("broken") & alone)
        halved = again & (F.size("missing") == F.col("n")) & ~alone
        at = F.lit(depth).alias("depth")
        done.append(j.select("batch", F.explode("items").alias("x")).where("x.answer <> ''").select("batch", "x.pos", F.col("x.answer").alias("translation"), at))
        ended = j.where(some & ~again).select("batch", alone.alias("alone"), F.when(F.col("broken"), "MALFORMED_MODEL_OUTPUT").when(F.col("bad"), "UNTRANSLATED_OUTPUT").otherwise("INCOMPLETE_MODEL_OUTPUT").alias("code"), F.explode("missing").alias("x"))
        single.append(ended.where("alone").select("batch", "x.pos", "x.text", "x.role", "x.source", at))
        failed.append(ended.where("not alone").select("batch", "x.pos", "code", at))
        open_ = j.where(again).select("batch", "node", halved.alias("halved"), "n", F.posexplode("missing").alias("i", "x"))
        half = F.when(F.col("i") < F.ceil(F.col("n") / 2), "0").otherwise("1")
        next_ = open_.select("batch", F.concat("node", F.when(F.col("halved"), half).otherwise("r")).alias("node"), "x.pos", "x.text", "x.role")
        # A batch that the service refused is over, whatever its other halves.
        work = written(next_.join(reduce(DataFrame.union, fatal).select("batch").distinct(), "batch", "left_anti"), "work")
        if work.isEmpty():
            break
    refused = written(reduce(DataFrame.union, fatal).groupBy("batch").agg(F.min(F.struct("status", "message")).alias("f")).select("batch", "f.*"), "refused")
    rest = written(reduce(DataFrame.union, single).join(refused.select("batch"), "batch", "left_anti"), "single")
    got = _single(rest, plain, target, kinds)
    log = F.lit(None).cast("string"), F.lit(0), empty
    parts = [
        reduce(DataFrame.union, done).select("batch", "pos", "translation", F.lit(True).alias("ok"), log[0].alias("code"), log[0].alias("stage"), log[1].alias("status"), "depth", log[2].alias("attempts")),
        reduce(DataFrame.union, failed).select("batch", "pos", F.lit("").alias("translation"), F.lit(False).alias("ok"), "code", F.lit("batch").alias("stage"), log[1].alias("status"), "depth", log[2].alias("attempts")),
    ]
    whole = parts[0].unionByName(parts[1]).join(refused.select("batch"), "batch", "left_anti").unionByName(got)
    attempt = F.array(F.struct(F.lit("batch").alias("stage"), F.col("status").alias("status"), F.lit("HTTP_ERROR").alias("code"), F.col("message").alias("message")))
    over = rows.select(F.col(batch).alias("batch"), F.col(pos).alias("pos")).join(refused, "batch")
    over = over.select("batch", "pos", F.lit("").alias("translation"), F.lit(False).alias("ok"), F.lit("HTTP_ERROR").alias("code"), F.lit("batch").alias("stage"), "status", F.lit(0).alias("depth"), attempt.alias("attempts"))
    return whole.unionByName(over).withColumnsRenamed({"batch": batch, "pos": pos})


def _single(rest: DataFrame, plain: AskPlain, target: str, kinds: dict[str, str]) -> DataFrame:
    """Texts alone: as they are if that is right; else in chunks, plainly, and by force, until a stage's answer holds. Texts of
    CHUNKED_FIRST chunks or more begin with chunks, those of two end with them."""
    joint = "" if re.search(Q.CHINESE_NAMES.removeprefix("(?i)"), target, re.I) else " "
    order = {1: ("normal", "forced"), 2: ("normal", "forced", "chunks"), CHUNKED_FIRST: ("chunks", "normal", "forced")}
    replies = "array<struct<source:string,answer:string,said:string,status:int,message:string>>"

    def call(step: int):
        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                modes, said, sizes = [], [], []
                for text in pdf["text"]:
                    parts = chunks(text)
                    stages = order[min(len(parts), CHUNKED_FIRST)]
                    mode = stages[step] if step < len(stages) else None
                    got = []
                    for part in () if mode is None else parts if mode == "chunks" else (text,):
                        r = plain(part, "forced-chunk" if mode == "chunks" else mode)
                        answer = r.answers.strip() if r.status < 400 and isinstance(r.answers, str) else ""
                        got.append({"source": normal_source_of(part), "answer": answer, "said": normal_source_of(answer), "status": r.status, "message": str(r.message)[:MESSAGE]})
                        if not answer:
                            break  # the rest would not be used
                    modes.append(mode)
                    said.append(got)
                    sizes.append(len(parts))
                whole = [joint.join(x["answer"] for x in got).strip() for got in said]
                yield pdf.assign(mode=modes, parts=sizes, said=said, whole=whole, normal=[normal_source_of(x) for x in whole])

        return run

    of_batch, of_pos = kinds.values()
    open_ = ["batch", "pos", "text", "role", "source", "depth", "attempts"]
    columns = f"batch {of_batch}, pos {of_pos}, text string, role string, source string, depth int, attempts array<{ATTEMPT}>"
    left = rest.withColumn("attempts", F.array().cast(f"array<{ATTEMPT}>"))
    kept = Q.source_preserving(F.col("source"), F.col("role"))
    good = [left.where(kept).select("batch", "pos", F.col("text").alias("translation"), "depth", "attempts")]
    left, over = left.where(~kept).select(*open_), []
    for step in range(3):
        asked = written(in_slices(left, call(step), f"{columns}, mode string, parts int, said {replies}, whole string, normal string"), "plain")
        weak = lambda x: (x["answer"] == "") | untranslated(x["source"], x["said"], target, F.col("role"))
        # The first chunk (or the only answer) that does not hold ends the stage.
        a = asked.where("mode is not null").withColumn("first", F.array_position(F.transform("said", weak), F.lit(True)).cast("int"))
        at = F.get("said", F.col("first") - 1)
        joined_weak = (F.col("first") == 0) & (F.col("mode") == "chunks") & untranslated(F.col("source"), F.col("normal"), target, F.col("role"))
        http = F.coalesce(at["status"], F.lit(200)) >= 400
        chunk = F.concat(F.lit("forced-chunk-"), F.col("first").cast("string"), F.lit("/"), F.col("parts").cast("string"))
        stage = F.when(joined_weak, "forced-chunk-combined").when(F.col("mode") == "chunks", chunk).when(F.col("mode") == "normal", "single-plain").otherwise("single-forced")
        entry = F.struct(stage.alias("stage"), F.when(http, at["status"]).otherwise(0).alias("status"), F.when(http, "TRANSLATION_FAILED").otherwise("UNTRANSLATED_OUTPUT").alias("code"), F.coalesce(at["message"], F.lit("")).alias("message"))
        a = a.withColumns({"fails": (F.col("first") > 0) | joined_weak, "entry": entry, "stops": http & ~at["status"].isin(*RETRYABLE)})
        good.append(a.where(~F.col("fails")).select("batch", "pos", F.col("whole").alias("translation"), "depth", "attempts"))
        bad = a.where("fails").withColumn("attempts", F.concat("attempts", F.array("entry")))
        over.append(bad.where("stops").select("batch", "pos", "depth", "attempts", F.lit("INCOMPLETE_MODEL_OUTPUT").alias("code")))
        left = bad.where("not stops").select(*open_).unionByName(asked.where("mode is null").select(*open_))
    over.append(left.select("batch", "pos", "depth", "attempts", F.lit("UNTRANSLATED_OUTPUT").alias("code")))
    none = F.lit(None).cast("string")
    fine = reduce(DataFrame.union, good).select("batch", "pos", "translation", F.lit(True).alias("ok"), none.alias("code"), none.alias("stage"), F.lit(0).alias("status"), "depth", "attempts")
    last = F.element_at("attempts", -1)
    lost = reduce(DataFrame.union, over).select("batch", "pos", F.lit("").alias("translation"), F.lit(False).alias("ok"), "code", F.coalesce(last["stage"], F.lit("single-fallback")).alias("stage"), F.coalesce(last["status"], F.lit(0)).alias("status"), "depth", "attempts")
    return fine.unionByName(lost)

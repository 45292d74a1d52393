"""The work list of batches against the same rules as a recursion, with models that fail by a hash of what they are asked."""
import zlib

from lectern.functions.split import chunks
from lectern.operators import batches as B
from pyspark.sql import functions as F

PROSE = "The samples were measured again and they show that many of the values do not change when the current is small"
HAN = "译文"


def h(*parts):
    return zlib.crc32("|".join(map(str, parts)).encode())


def wish(text):
    return f"{HAN}{h(text) % 1000}"


def ask(texts, depth):
    k = h(*texts, depth) % 12
    if "teapot" in "".join(texts):
        return B.Reply(None, 418, "teapot")
    if k < 3 and len(texts) > 1 or "broken" in "".join(texts):
        return B.Reply(None)
    if k == 3:
        return B.Reply([wish(t) for t in texts[:-1]])
    answers = []
    for i, t in enumerate(texts):
        q = h(t, depth) % 6
        if q == 0 or "missing" in t:
            continue
        answers.append((f"t{i}", t if q == 1 or "same" in t else wish(t)))
    return B.Reply(answers + [("t99", "x"), ("t0x", "y")] if k % 2 else dict(answers))


def plain(text, mode):
    k = h(text, mode) % 5
    if k == 0:
        return B.Reply(None, 429 if h(text) % 2 else 401, f"busy {mode}")
    if k == 1 or "never" in text:
        return B.Reply(text)
    return B.Reply(f" {wish(text)} ")


def is_source(text, answer):
    return len(text) >= 70 and answer == text


class Refused(Exception):
    pass


def one(text):
    """(translation, code, attempts) of a single text."""
    parts, log = chunks(text), []

    def stage(mode):
        got = []
        for i, p in enumerate(parts if mode == "chunks" else [text]):
            r = plain(p, "forced-chunk" if mode == "chunks" else mode)
            name = f"forced-chunk-{i + 1}/{len(parts)}" if mode == "chunks" else "single-plain" if mode == "normal" else "single-forced"
            if r.status >= 400:
                log.append((name, r.status, "TRANSLATION_FAILED", r.message))
                if r.status not in B.RETRYABLE:
                    raise Refused
                return None
            if not (r.answers or "").strip() or is_source(p, r.answers.strip()):
                log.append((name, 0, "UNTRANSLATED_OUTPUT", ""))
                return None
            got.append(r.answers.strip())
        return "".join(got)

    try:
        for mode in ["chunks", "normal", "forced"] if len(parts) >= 3 else ["normal", "forced", "chunks"] if len(parts) == 2 else ["normal", "forced"]:
            said = stage(mode)
            if said:
                return said, None, log
    except Refused:
        return "", "INCOMPLETE_MODEL_OUTPUT", log
    return "", "UNTRANSLATED_OUTPUT", log


def recursed(texts, depth=0):
    """[(translation, code, attempts)] of a request."""
    r = ask(texts, depth)
    if r.status >= 400:
        raise Refused
    halves = lambda: (m := -(-len(texts) // 2)) and recursed(texts[:m], depth + 1) + recursed(texts[m:], depth + 1)
    if r.answers is None:
        if len(texts) == 1:
            return [one(texts[0])]
        return halves() if depth < 4 else [("", "MALFORMED_MODEL_OUTPUT", [])] * len(texts)
    said = B.aligned(r.answers, len(texts))
    bad = [bool(a) and is_source(t, a) for t, a in zip(texts, said)]
    said = ["" if b else a for a, b in zip(said, bad)]
    out = [(a, None, []) for a in said]
    missing = [i for i, a in enumerate(said) if not a]
    if missing and depth < (2 if any(bad) else 4):
        if len(missing) == len(texts) > 1:
            return halves()
        for i, x in zip(missing, recursed([texts[i] for i in missing], depth + 1)):
            out[i] = x
    elif missing and len(texts) == 1:
        return [one(texts[0])]
    elif missing:
        for i in missing:
            out[i] = ("", "UNTRANSLATED_OUTPUT" if any(bad) else "INCOMPLETE_MODEL_OUTPUT", [])
    return out


def test_work_list_equals_recursion(spark):
    batches = []
    for b in range(60):
        n = 1 + h("n", b) % 9
        texts = [f"{PROSE} {b} {i}" if h(b, i) % 4 else f"short {b} {i}" for i in range(n)]
        if b % 10 == 3:
            texts[0] += " missing" if b % 20 == 3 else " same"
        if b % 10 == 5:
            texts[-1] += " broken"
        if b % 10 == 7:
            texts[n // 2] = ". ".join(f"{PROSE} {b} {j} here" for j in range(2 + b % 12)) + (" never" if b % 4 == 3 else "")
        if b in (11, 29):
            texts[n // 2] += " teapot"
        batches.append(texts)
    rows = [(b, i, t) for b, ts in enumerate(batches) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "batch long, pos int, text string")
    got = {(r["batch"], r["pos"]): (r["translation"], r["code"], [tuple(a) for a in r["attempts"]]) for r in B.translate_batches(df, ask, plain).collect()}
    assert len(got) == len(rows)
    codes = set()
    for b, texts in enumerate(batches):
        try:
            want = recursed(texts)
        except Refused:
            want = [("", "HTTP_ERROR", [("batch", 418, "HTTP_ERROR", "teapot")])] * len(texts)
        assert [got[b, i] for i in range(len(texts))] == want, b
        codes |= {c for _, c, _ in want}
    assert codes >= {None, "HTTP_ERROR", "UNTRANSLATED_OUTPUT"}
    assert B.translate_batches(df.limit(0), ask, plain).count() == 0


def test_answers_are_aligned():
    assert B.aligned(["a", "b"], 2) == ["a", "b"] and B.aligned(["a"], 2) == ["", ""] and B.aligned([], 2) == ["", ""]
    assert B.aligned([("t1", "x"), ("t0", " "), ("t1", "y"), ("t2", "z"), ("u0", "w"), ("t0", 3)], 2) == ["", "y"]
    assert B.aligned({"t0": "x", "t5": "y", "t1": None}, 2) == ["x", ""]


def test_preserved_texts_and_roles(spark):
    df = spark.createDataFrame([(1, 0, "doi:10.1000/xyz missing", ""), (1, 1, "https://a.b/c broken", ""), (2, 0, None, ""), (3, 0, "doi:10.1000/zz missing", "figure-caption")], "batch long, pos int, text string, role string")
    got = {(r["batch"], r["pos"]): r for r in B.translate_batches(df, lambda t, d: B.Reply([] if "missing" in t[0] else None), lambda t, m: B.Reply(""), role=F.col("role")).collect()}
    assert got[1, 0]["translation"].startswith("doi:") and got[1, 1]["ok"] and not got[2, 0]["ok"] and got[3, 0]["code"] == "UNTRANSLATED_OUTPUT"

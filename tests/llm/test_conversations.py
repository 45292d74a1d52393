"""Repair of conversations against an enumeration of all edits, whole and in blocks, and the damage by hand."""
import hashlib
import itertools
import random
import re
import zlib

from lectern.llm import conversations as C


def by_enumeration(turns):
    """(cost, audit, repaired text) of the cheapest edits, ties ASCII-least, among all with up to two inserts in a place."""
    seen, faults = set(), []
    for role, text in turns:
        full = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not full else "duplicate" if (role, text) in seen else "" if full[-1] in ".!?" else "truncated")
        seen.add((role, text))
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for places in itertools.product(inserts, repeat=len(turns) + 1):
        for edits in itertools.product(("K", "user", "assistant", "D"), repeat=len(turns)):
            cost, audit, out = 0, "", []
            for i, ins in enumerate(places):
                cost, audit = cost + 2 * len(ins), audit + "I" * len(ins)
                out += [f"{r}:" for r in ins]
                if i < len(turns):
                    e, (role, text) = edits[i], turns[i]
                    cost += {"K": 0, "D": 3}.get(e, 2) + (faults[i] == "truncated" and e != "D") + 1000 * (faults[i] in ("blank", "duplicate") and e != "D")
                    audit += e if e in "KD" else "R"
                    if e != "D":
                        out.append(f"{role if e == 'K' else e}:{text}")
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] if x[:1] in "sua" else "?" for x in out)):
                best = (cost, audit, "\n".join(out))
    return best


def test_cheapest_edits_by_enumeration():
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", "", " "], ["Fine.", "cut", " \t", "Yes!", "Fine. ", "é"]
    cases = [[]] + [[(r, t)] for r in set(roles) for t in texts] + [[(rng.choice(roles), rng.choice(texts)) for _ in range(2)] for _ in range(60)] + [[(rng.choice(roles[:5]), rng.choice(texts)) for _ in range(3)] for _ in range(4)]
    for turns in cases:
        counts, audit = C._whole([(None, r, t) for r, t in turns])
        text = "\n".join(f"{r}:{t}" for r, t, _ in C.repaired(turns, audit))
        assert (counts[-1], audit, text) == by_enumeration(turns), turns


def talk(rng, n):
    roles = ["system"] + ["user", "assistant"] * n
    out = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "system", "x"]) if rng.random() < 0.2 else roles[i]
        out.append((role, rng.choice(["Yes.", "No!", "cut", ""]) if rng.random() < 0.2 else f"line {rng.randrange(3 * n)}{rng.choice(['.', ''])}"))
    return out


def test_blocks_change_no_result(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(c, t if rng.random() > 0.1 else None, r, x if rng.random() > 0.05 else None) for c, n in ((1, 90), (2, 3), (None, 40), (4, 1), (5, 61)) for t, (r, x) in enumerate(talk(rng, n))]
    rows += [(7, 3, "user", "same")] * 25 + [(8, None, None, None)] * 12
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, said = [], []
    for size in (2000, 7):
        monkeypatch.setattr(C, "ROWS", size)
        for damage in (False, True):
            r = C.Repair(df, damage=damage)
            got.append(sorted((tuple(x) for x in r.summary().collect()), key=str))
            m = sorted(((x["conv_id"], x["block"], x["place"], x["role"], x["text"], x["edit"]) for x in r.messages().collect()), key=lambda x: (str(x[0]), x[1:3]))
            said.append([(x[0], *x[3:]) for x in m])
    assert got[0] == got[2] and got[1] == got[3] and said[0] == said[2] and said[1] == said[3] and len(got[0]) == 7
    for conv, *_, audit, sha in got[1]:
        own = [(r, t, e) for c, r, t, e in said[1] if c == conv]
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in own).encode()).hexdigest() == sha
        assert [e for *_, e in own] == [e for e in audit if e != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, *_ in own))


def test_damage_and_odd_rows(spark):
    rows = [(c, t, r, x) for c in (1, 2, 3, None) for t, (r, x) in enumerate([("user", "A. b? c!"), ("assistant", None), (None, "x"), ("user", "y" * 100_000)] * 5)] + [(9, None, "user", "q.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "'x' as there")
    want = []
    for c, t, r, x in rows:
        c0, t0, r, x = (" " if v is None else v for v in (c, t, r, x))
        do = zlib.crc32(f"{c0}:{t0}".encode()) % 20
        x, r = {1: "", 2: re.sub("[.!?]", "", x)}.get(do, x), "user" if do == 4 else r
        want += [(c, t, r, x, do != 0)] * (2 if do == 3 else 1)
    assert sorted(map(str, (tuple(x) for x in C.damaged(df).collect()))) == sorted(map(str, want))
    got = {r["conv_id"]: r for r in C.repair_conversations(df, damage=True).collect()}
    assert set(got) == {1, 2, 3, None, 9} and C.repair_conversations(df.limit(0)).count() == 0
    c = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(c, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert tuple(C.repair_conversations(gone, damage=True).first()) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

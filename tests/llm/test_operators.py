"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, html_text, licences, mixing, mpeg, pii, quality_rules, weak_labels
from lectern.llm.components import components
from lectern.llm.ngram_join import ngram_jaccard
from lectern.llm.suffix_array import permuted_prefixes, suffix_array
from lectern.llm.suffix_dedup import suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_docs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(30, 80))) for _ in range(12)]
    rows = [(i, t, None, rng.choice(["a", "a", "b", None]), None) for i, t in enumerate([None, "", "  \n\t", "one two", "one two", "a" * 5000, "ab " * 900, "é" * 400, "x\x0by"])]
    for i in range(9, 150):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w + rng.choice(base).split(" ")[: rng.choice([0, 0, 20, 40])]), "en", rng.choice(["a", "a", "b"]), 5))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("kept", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        s = bytes(rng.randrange(rng.choice([1, 2, 4])) + 97 for _ in range(rng.randint(1, 70))) * rng.choice([1, 1, 3])
        t = np.frombuffer(s, np.uint8)
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        p = permuted_prefixes(t, sa, 20)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while n < 20 and b + n < len(s) and a + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert p[b] == n


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, hot):
    rows, df = odd_docs(spark)
    seen, want = set(), {}
    for i, x, *_ in rows:
        b = (x or "").encode()
        cover = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cover[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        kept = bytes(c for c, v in zip(b, cover, strict=True) if not v)
        want[i] = (len(b), sum(cover), sum(v and (k == 0 or not cover[k - 1]) for k, v in enumerate(cover)), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup(df, hot=hot).collect()} == want
    assert suffix_dedup(empty(spark)).count() == 0
    twice = suffix_dedup(spark.createDataFrame([(1, "q" * 30 + "x" * 90), (1, "q" * 30 + "x" * 90), (None, "q" * 30 + "x" * 90)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in twice] == [0, 0, 0]


def brute_components(rows):
    sets = {}
    for i, x, *_ in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_jaccard(spark):
    rows, df = odd_docs(spark)
    assert {r[0]: (r[1], r[2]) for r in ngram_jaccard(df).collect()} == brute_components(rows)
    assert ngram_jaccard(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_quality_rules(spark):
    rows, df = odd_docs(spark)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    for i, x, *_ in rows:
        w = WORDS.findall(x or "")
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        covered = {p + o for ps in at.values() if len(ps) > 1 for p in ps for o in range(5)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered)), i
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.quality_rules(empty(spark)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_pii(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(n) <= 19 and luhn(n or "1"), "phone": 9 <= len(n) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(3)
    bits = ["a.b@c.d.e", "%x@y.z", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (643) 555-5742", "+1+2", "  ", "é𝒳", "a", "-", "x@y", "5" * 25, "\n", "0000000000000"]
    texts = [None, "", "9" * 3000, "a" * 20000 + "@b.c", " 1.1.1.1" * 700, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit(1))
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["pii"] if x["kind"] in PLAIN] for r in pii.find_pii(df).collect()}
    for i, x in enumerate(texts):
        assert got[i] == brute_pii(x), repr(x)
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_of_other_kinds_and_redaction(spark):
    rows = [(1, "My IBAN is GB82 WEST 1234 5698 7654 32 ok"), (2, "IBAN GB82 WEST 1234 5698 7654 33"), (3, "SSN 123-45-6789"), (4, "part 123-45-6789"), (5, "mail a@b.co, or 10.0.0.1"), (6, None)]
    out = {r["doc_id"]: r for r in pii.redact(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    kinds = {i: [x["kind"] for x in r["pii"]] for i, r in out.items()}
    assert "iban" in kinds[1] and "iban" not in kinds[2] and kinds[3] == ["identity"] and kinds[4] == []
    assert out[5]["text"] == "mail <EMAIL>, or <IP>" and out[6]["text"] is None


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(TOKENIZER), bpe.WordBPE(TOKENIZER)
    rng = random.Random(5)
    texts = ["", " ", "hello<|endoftext|>World <|startoftext|>", "don't we'll I'M ΣΑΣ İstanbul", "a" * 3000, "".join(rng.choice("abcdefghij") for _ in range(3000)), "é" * 700, "é x", "1234 ½²", "\x1c\x1d x\x85y​z", "日本語 текст 🙂🙂"]
    texts += ["".join(rng.choice("abc 'st.é1!\n") for _ in range(50)) for _ in range(200)]
    for x in texts:
        ids = lib.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids, repr(x)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    rows, df = odd_docs(spark)
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(df, TOKENIZER).collect()}
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, TOKENIZER).select("doc_id", "ids").collect()}
    for i, x, *_ in rows:
        want = lib.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want and digests[i]["n_tokens"] == len(want)
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_mpeg(spark):
    for text in (None, "", "abc", "é" * 1000, "x" * 192, "y" * 193):
        n, payload = mpeg.payload_of(text)
        media = mpeg.write_stream(payload)
        s = mpeg.read_stream(media)
        assert mpeg.payload_from(media, s) == payload and len(payload) % 192 == 0 and s.failed == s.skipped == 0
        assert s.duration_us == len(payload) // 192 * 24000 and s.table == "Info" and s.table_frames == len(s.offsets)
        broken = bytearray(media)
        broken[int(s.offsets[-1]) + 9] ^= 1
        assert mpeg.read_stream(bytes(broken)).failed == 1
        noisy = mpeg.read_stream(b"junk\xff\xfb" + media[19:] + b"TAG" + bytes(125))
        assert len(noisy.offsets) == len(s.offsets) and noisy.skipped > 0 and "ID3v1" in noisy.tags
    assert mpeg.read_stream(b"").samples == 0
    rows, df = odd_docs(spark)
    got = mpeg.audio_columns(df).collect()
    assert len(got) == len(rows) and all(r["n_bytes"] == len((rows[r["doc_id"]][1] or "").encode()) for r in got)


def test_html(spark):
    page = '<p class="comment">c<p>d</p><nav>n</nav><article><header><h1>T &amp; U</h1></header><div class="ad">A</div><p>B  &eacute;<br>x<aside>s</aside>tail<script>var a="</p>"</script><section class="comments"><p>k</p></section></article><footer>f'
    assert [t for k, t in html_text.blocks(page) if k == html_text.INSIDE] == ["T & U", "B é x", "tail"]
    plain = [f"<ul><li>Home page link one two three four five</li></ul><p>unique words {i} {i * 7} {i * 11} here today</p><p>All rights reserved by the company of this host</p>" for i in range(5)]
    rows = [(1, "http://a.b/", page), (2, None, None), (3, "x", "")] + [(10 + i, "http://h.x/", p) for i, p in enumerate(plain)]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "T & U\nB é x\ntail" and got[2]["text"] == "" and got[3]["n_chars"] == 0
    assert all(got[10 + i]["text"] == f"unique words {i} {i * 7} {i * 11} here today" for i in range(5))


def test_mixing_hits_target_weights(spark):
    rows = [(i, "x" * 100, "en", "a" if i < 3000 else "b", 100) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r["source"] for r in mixing.mix_sources(df, {"a": 1.0, "b": 3.0}).collect())
    assert abs(got["a"] - 1000) < 150 and abs(got["b"] - 3000) < 250
    again = mixing.mix_sources(df.repartition(7), {"a": 1.0, "b": 3.0})
    assert Counter(r["source"] for r in again.collect()) == got
    assert mixing.mix_sources(empty(spark)).count() == 0
    odd_rows, odd = odd_docs(spark)
    assert mixing.mix_sources(odd).count() > 0


def test_poisson_inverse(spark):
    u = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u")).select(mixing.poisson_inverse(F.col("u"), F.lit(3.7)).alias("k"))
    mean, var = u.agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(mean - 3.7) < 0.01 and abs(var - 3.7) < 0.02


def test_quality_classifier_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    got = weak_labels.quality_classifier(docs).join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got)
    assert right >= 0.95 * len(got)
    clean = [r["kept"] for r in got if r["quality"]]
    assert sum(clean) >= 0.97 * len(clean)
    assert weak_labels.quality_classifier(empty(spark)).count() == 0
    rows, df = odd_docs(spark)
    assert weak_labels.quality_classifier(df).count() == len(rows)


def test_licences(spark):
    rows = [(1, "Some text here.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "All rights reserved."), (3, "He had a license to kill, of course."), (4, None), (5, "plain text\nwith lines"), (6, "Released under the MIT License.")]
    rows += [(10 + i, f"the quick brown fox {i} jumps over the lazy dog and runs\nanother line of text follows it here", ) for i in range(50)]
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["families"] for i in (1, 2, 3, 4, 5, 6)] == ["apache-2.0", "proprietary", "", "", "", "mit"]
    assert got[3]["n_unknown"] == 1 and got[1]["found"].startswith("1:apache-2.0") and all(got[i]["n_licences"] == 0 for i in range(10, 60))
    assert licences.scan_licences(empty(spark)).count() == 0

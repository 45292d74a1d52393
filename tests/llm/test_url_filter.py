"""Address filters against plain Python: rules one by one and as a table, links of pages, components by hand."""
import random
from urllib.parse import urljoin

import duckdb

from lectern.llm import oracles
from lectern.llm import url_filter as U


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: (len(r.host + r.path), r.verdict == "allow"), default=None)


def name(url):
    from urllib.parse import urlsplit

    p = urlsplit(url)
    return p.netloc.lower(), p.path or "/", p.query


def plain(rows, rules, links):
    """{id: (host, path, rule, verdict)} with components by label spreading."""
    group = {}
    ends = {}
    for a, b in links:
        for x in (a, b):
            group.setdefault(name(x), name(x))
            ends.setdefault(name(x), x)
    for _ in range(len(group) + 1):
        for a, b in links:
            low = min(group[name(a)], group[name(b)])
            group[name(a)] = group[name(b)] = low
    bad = {group[n] for n, u in ends.items() if (r := plain_rule(u, rules)[2]) and r.verdict == "block"}
    out = {}
    for i, url in rows:
        host, path, rule = plain_rule(url, rules)
        alias = host != "" and name(url) in group and group[name(url)] in bad
        out[i] = (host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if alias else "allow")
    return out


URLS = [None, "", "no address", "://", "http://", "mailto:x@y.org", "http://ORG/", "http://a.ORG/x", "https://Example.Org/es/1?q#f", "http://www.example.org/en/12", "http://example.org/en/2", "http://example.org", "http://x.com/fr/", "http://x.com/fr", "ftp://com/de/y", "http://xcom/de/", "http://a.b/?://c.org/", "http://É.com/de/", "http://a.com:80/de/", "http://" + "a." * 5000 + "com/de/" + "x" * 10_000, "http://y.net/\n/de/"]


def test_rules_one_by_one_and_as_a_table(spark, monkeypatch):
    rows = list(enumerate(URLS)) + [(None, "http://x.com/de/"), (3, "http://x.com/de/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "'r' as rule")
    got = []
    for few in (64, 0):
        monkeypatch.setattr(U, "FEW", few)
        got.append(sorted((tuple(r) for r in U.judge_urls(df, page=None).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    want = plain(enumerate(URLS), U.RULES, [])
    assert {r[0]: r[1:5] for r in got[0] if r[0] not in (None, 3)} == {i: w for i, w in want.items() if i != 3}
    assert [r[4:] for r in got[0] if r[0] is None] == [("block", "rule")] and U.judge_urls(df.limit(0), page=None).count() == 0
    many = [*U.RULES, U.Rule("block", "net", "/"), U.Rule("allow", "net", "/"), U.Rule("block", "b", "/?")]
    assert {r[0]: r[1:5] for r in U.judge_urls(df, many, page=None).collect() if r[0] not in (None, 3)} == {i: w for i, w in plain(enumerate(URLS), many, []).items() if i != 3}


def test_blocks_are_carried_on(spark):
    rng = random.Random(4)
    urls = [f"{rng.choice(['http', 'https'])}://h{i % 40}.{rng.choice(['net', 'net', 'net', 'com', 'org'])}/{rng.choice(['de', 'fr', 'xx', 'yy'])}/{i}" for i in range(300)]
    rows, links = [], []
    for i, u in enumerate(urls):
        html = "<head>" + "<link rel=stylesheet href=x.css>"
        if i % 3 == 0:
            ref = rng.choice([urls[rng.randrange(300)] + "#top", f"/de/{rng.randrange(300)}", f"../xx/{i}", "?a=1&amp;b=2", "https://spam.com/de/x"])
            html += rng.choice(['<link rel="Canonical other" href="{}">', "<LINK href='{}' REL=canonical >"]).format(ref) + "<link rel=canonical href=/second>"
            links.append((u, urljoin(u, ref.replace("&amp;", "&"))))
        if i % 7 == 0:
            ref = urls[rng.randrange(300)]
            html += f"<meta http-equiv=Refresh content=\"0; URL='{ref}'\">"
            links.append((u, ref))
        html += "<!-- <link rel=canonical href=https://spam.com/de/> --><script>'<link rel=canonical href=https://spam.com/de/>'</script>"
        rows.append((i, u, html))
    rows += [(300, "http://b.net/q/1", "<base href=//spam.com/><link rel=canonical href=de/z>"), (301, "http://lone.net/", None), (302, None, "<link rel=canonical href=/x>")]
    links.append(("http://b.net/q/1", "http://spam.com/de/z"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = [(urls[5], urls[6]), ("http://lone.net", "https://spam.com/de/x"), ("x", "y")]
    want = plain([(i, u) for i, u, _ in rows], U.RULES, links + more[:2])
    got = {r[0]: tuple(r[1:5]) for r in U.judge_urls(df, redirects=spark.createDataFrame(more, "source string, target string")).collect()}
    assert got == want
    carried = sum(v == "block" and r is None for _, _, r, v in want.values())
    assert carried > 20 and got[301][3] == "block" and got[300][3] == "block"


def test_statement_on_odd_addresses(spark):
    rows = list(enumerate(URLS))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(oracles.OP11).fetchall()}
    assert {r[0]: tuple(r[1:5]) for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), page=None).collect()} == want

"""Main text of pages: what the scanner names, copies of pages, runs inside blocks, hosts of several parts."""
import random
import time

from lectern.llm import html_text


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_are_named_by_elements_that_were_opened(spark):
    body = "<p>the story {} of the day in full</p>"
    opened = ["<div role='main'>{}</div>", "<div role=main>{}</div>", '<div ROLE="Main">{}</div>', "<div id=a role='main'>{}</div>", '<div role="main">{}</div>', "<ARTICLE>{}</ARTICLE>"]
    unopened = ["<!-- <article> -->{}", "<script>x = '<main>'</script>{}", "<p title='role=main'>{}", "<!-- role=main -->{}", '<div data-role="main">{}</div>']
    rows = [(i, f"http://h{i}.x/", f"<p>menu</p>{w.format(body.format(i))}") for i, w in enumerate(opened + unopened)]
    got = texts(spark, rows)
    for i in range(len(rows)):
        story = f"the story {i} of the day in full"
        assert got[i] == (story if i < len(opened) else f"menu\n{story}")


def test_copies_keep_their_text_and_only_runs_are_cut(spark):
    story = "<p>a story of nine words that stands here alone</p><p>short end</p>"
    menu = "<p>home news sport culture about us and contact</p>"
    mixed = "<p>home news sport culture about us then some words of {} only</p>"
    rows = [(i, "http://h.x/", story + menu) for i in range(3)] + [(3, "http://h.x/", story + menu)] * 2
    rows += [(4, "http://h.x/", mixed.format("four")), (5, "http://h.x/", "<p>a tail alone</p>" + menu)]
    got = texts(spark, rows)
    assert all(got[i] == "a story of nine words that stands here alone\nshort end" for i in range(4))
    assert got[4] == "then some words of four only" and got[5] == "a tail alone"


def test_parts_of_a_host_change_no_result(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    notes = [" ".join(word() for _ in range(rng.choice([2, 4, 7, 12]))) for _ in range(60)]
    rows = []
    for i in range(200):
        own = [" ".join(word() for _ in range(20)), rng.choice(notes), rng.choice(notes) + " " + word(), ""]
        rows.append((i, rng.choice(["http://h.x/", "http://h.x/", "http://g.x/"]), "".join(f"<p>{x}</p>" for x in own) + rng.choice(["", "<main>its article</main>"])))
    rows += [(200 + i, "http://h.x/", rows[i][2]) for i in range(30)]  # copies, mostly in other parts
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(tuple(r) for r in html_text.main_text(df).collect())]
    monkeypatch.setattr(html_text, "PART", 1500)
    got.append(sorted(tuple(r) for r in html_text.main_text(df).collect()))
    assert got[0] == got[1] and sum(r[-1] for r in got[0]) > 1000


def test_no_character_is_lost_and_names_are_read_whole(spark):
    rows = [
        (1, "http://a.b/", "<article><p>a\x00b</p><p>c\x01d</p></article>"),
        (2, "http://a.b/", '<article><p>first</p><div class="share-price">Shares rose</div><div class="share-bar">Share this</div><p class="header">no</p><div id=side_2>x</div><div class="country-side">hills</div></article>'),
        (3, "http://a.b/", "<article>" + "<p>long text of words </p>" * 50_000 + "</article>"),
    ]
    got = texts(spark, rows + rows[:1])
    assert got[1] == "a\x00b\nc\x01d" and got[2] == "first\nShares rose\nhills" and got[3].count("\n") == 49_999
    extra = spark.createDataFrame([(1, "http://a.b/", "<main>x</main>", "p", 1)], "page_id long, url string, html string, part string, host int")
    assert html_text.main_text(extra).first()["text"] == "x" and html_text.main_text(extra.limit(0)).count() == 0


def test_names_quotes_and_heads(spark):
    rows = [
        (1, "http://a.b/", '<article><p class="navy-history">ships</p><p id="menuetto">dance</p><p class=promontory-guide>cliffs</p><p class="main-nav">no</p><p class="promo_box">no</p></article>'),
        (2, "http://a.b/", '<p class="x>Hello one</p>'),
        (3, "http://a.b/", "<main><p title=\"a hidden place\">seen</p><p hidden>not seen</p><p data-x='>'>quoted</p><p class=\"" + "y" * 200_000 + "\">long name</p></main>"),
        (5, "http://a.b/", "<article>" + "İ" * 50 + "<script>x</SCRIPT>after the script<p>end</article>"),
        (4, "http://a.b/", "<head><title>no</title><body><article>an end tag of head may be left out</article>"),
    ]
    assert texts(spark, rows) == {1: "ships\ndance\ncliffs", 2: "Hello one", 3: "seen\nquoted\nlong name", 4: "an end tag of head may be left out", 5: "İ" * 50 + "after the script\nend"}


def test_odd_markup_takes_linear_time():
    n = 60_000
    odd = ['<p class="' * n, "<p>" * n + '<p class="', "<p a='\"" * n, "<div>" * n + "</b>" * n, "<p " + "a" * 5 * n + ">", "<p a=" + " " * 5 * n, "<!" * n, "<" * n]
    began = time.perf_counter()
    for page in odd:
        html_text.blocks(page)
    assert time.perf_counter() - began < 20

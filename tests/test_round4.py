"""Cases of the fourth round of findings: each would have failed before."""
import random

import duckdb
import pytest
from lectern.operators import layout
from lectern.plans.catalogue import ORACLES, QUERIES


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return con


def same_rows(spark, tmp_path, con, name):
    got = QUERIES[name](spark, str(tmp_path))
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    return sorted(map(tuple, got.select(*columns).collect())), sorted(rel.fetchall())


def test_equal_paragraphs_side_by_side_both_stay(spark, tmp_path):
    # A paragraph of three rows heads the left column, is followed by 36 rows of others, and heads the right one again.
    text = " ".join(f"word{i % 10}" for i in range(30))
    con = documents(spark, tmp_path, [(1, "\n".join([text, *["other words"] * 18, text]))])
    got, want = same_rows(spark, tmp_path, con, "page_paragraphs")
    assert got == want and len([r for r in want if r[-1] > 1]) == 2


def texts(spark, tmp_path):
    # Long words, blank lines, white space of other alphabets, a page and more, an id that two rows share, no text, no id.
    long = "\n".join(" ".join(f"w{'x' * (i * j % 31)}{j}" for j in range(1 + i * 7 % 40)) for i in range(60))
    rows = [(1, long), (2, ""), (3, None), (4, "a\n\n\n12.5 %\nnon\u00a0breaking \u2003 space x\nco-\nword"), (5, "one two"), (5, "\n\nthree four " + long.split("\n")[30]), (None, "of no id")]
    return documents(spark, tmp_path, rows)


@pytest.mark.parametrize("name", ["page_lines", "page_paragraphs"])
def test_texts_are_dealt_out_once_and_nothing_is_sorted(spark, tmp_path, name):
    con = texts(spark, tmp_path)
    got, want = same_rows(spark, tmp_path, con, name)
    assert got == want and {r[0] for r in want} == {1, 4, 5}
    (tmp_path / "own").mkdir()
    documents(spark, tmp_path / "own", [(1, "one two\nthree"), (2, "four")])
    plan = QUERIES[name](spark, str(tmp_path / "own"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Window" not in plan


def test_copies_are_found_page_by_page_without_joins(spark, tmp_path):
    long = [f"Line {n % 7} of many words, long enough to be compared with what covers it, and {'more ' * (n % 5)}to the end." for n in range(130)]
    rows = [(1, "\n".join(long)), (2, ""), (3, None), (4, "short\n\n" + long[3]), (5, long[0]), (5, "\n" * 61 + "\n".join(long[:9])), (None, "\n".join(long[:9]))]
    con = documents(spark, tmp_path, rows)
    rel = con.execute(ORACLES["overlapping_copies_removed"]).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [tuple(r) for r in QUERIES["overlapping_copies_removed"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(rel, key=key) and len(got) > 100
    (tmp_path / "own").mkdir()
    documents(spark, tmp_path / "own", rows[:2])
    plan = QUERIES["overlapping_copies_removed"](spark, str(tmp_path / "own"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_copies_equal_every_pair_compared():
    # The sweep finds what a comparison of all pairs finds, with lines and without.
    rng = random.Random(4)
    for _ in range(150):
        rows = []
        for n in range(14):
            y, lines = rng.uniform(0, 60), [rng.uniform(0, 60) for _ in range(rng.randrange(4))]
            rows.append((n, "ab" * rng.randrange(38, 46) + rng.choice(["", "c", " c!"]), rng.uniform(0, 40), y, rng.uniform(10, 60), rng.uniform(5, 40), rng.choice([None, lines])))
        letters = [layout.OTHERS.sub("", r[1]).lower() for r in rows]
        want = {(a[0],) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and 80 <= len(letters[i]) <= len(letters[j]) and letters[i] in letters[j] and layout._covers(a, b)}
        assert set(layout.copies_of(rows)) == want

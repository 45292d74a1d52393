"""The outbox: whatever is interrupted, each batch is ordered once, and every answer finds its segments."""
import json
import random
from pathlib import Path

from lectern.operators.outbox import MOST_TRIES, Outbox

SCHEMA = "session long, seq long, source string, start double, end double"


def service_in(folder):
    """A service that keeps its orders in a folder: the first question for an id is an order, later ones ask how it is."""

    def service(request, cues):
        order = Path(folder) / request
        if not order.exists():
            order.write_text(json.dumps(cues))
            return "running", []
        assert json.loads(order.read_text()) == [list(c) for c in cues]
        if any("bad" in x for _, x in cues):
            return "failed", []
        if any("twist" in x for _, x in cues) and len(list(Path(folder).iterdir())) % 2:
            return "complete", [("0", "wrong")]
        return "complete", [(i, f" T:{x} ") for i, x in cues]

    return service


def segments(spark):
    rng = random.Random(1)
    rows = []
    for k in (1, 2):
        at = 0.0
        for i in range(8):
            rows.append((k, i, f"{'bad' if (k, i) == (2, 4) else 'word'} {k} {i}" + ("." if rng.random() < 0.3 else ""), at, at + 3))
            at += rng.choice([3.0, 3.5, 9.0])
    rows += [(9, 0, " ", 0.0, 1.0), (9, 1, None, 1.0, 2.0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_restarts_order_nothing_twice(spark, tmp_path):
    rows, df = segments(spark)
    plain_orders = tmp_path / "a"
    plain_orders.mkdir()
    plain = Outbox(spark, str(tmp_path / "plain")).run(df, service_in(str(plain_orders)))
    got = {(r["session"], r["seq"]): (r["translation"], r["status"]) for r in plain.collect()}
    assert len(got) == len(rows) and got[9, 0] == (" ", "complete") and got[9, 1] == ("", "complete")
    for k, i, x, *_ in rows:
        if k not in (2, 9):
            assert got[k, i] == (f"T:{x}", "complete")
    lost = [i for (k, i), (t, s) in got.items() if k == 2 and t is None]
    assert 4 in lost and all(s == "failed" for (k, _), (_, s) in got.items() if k == 2)
    # The same with a restart after every part of every step: a new outbox on the same folder.
    orders, where, rng = tmp_path / "b", str(tmp_path / "restarted"), random.Random(2)
    orders.mkdir()
    service = service_in(str(orders))
    Outbox(spark, where).begin(df)
    Outbox(spark, where).begin(df.limit(1))
    for _ in range(400):
        if Outbox(spark, where).state().isEmpty():
            break
        rng.choice([lambda: Outbox(spark, where).claim(), lambda: Outbox(spark, where).ask(service), lambda: Outbox(spark, where).ask(service), lambda: Outbox(spark, where).settle()])()
    Outbox(spark, where).step(service)
    again = {(r["session"], r["seq"]): (r["translation"], r["status"]) for r in Outbox(spark, where).results().collect()}
    assert again == got
    assert {p.name: p.read_text() for p in orders.iterdir()} == {p.name: p.read_text() for p in plain_orders.iterdir()}
    bad = [p for p in orders.iterdir() if "bad" in p.read_text()]
    assert len(bad) == MOST_TRIES


def test_half_a_table_does_not_count(spark, tmp_path):
    _, df = segments(spark)
    box = Outbox(spark, str(tmp_path / "box"))
    box.begin(df)
    box.claim()
    (tmp_path / "box/state/2").mkdir()
    (tmp_path / "box/state/2/part-0.parquet").write_text("half")
    assert box._versions() == [0, 1]
    (tmp_path / "orders").mkdir()
    box.ask(service_in(str(tmp_path / "orders")))
    assert box._versions() == [1, 2] and box.state().where("request is not null").count() > 0

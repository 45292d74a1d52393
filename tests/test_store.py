"""The store against a dict; folders of JSON with files that are none."""
import json
import random

from lectern.sources.store import Store, read_folder
from pyspark.sql import functions as F


def test_changes_against_a_dict(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = Store(spark, str(tmp_path / "store"))
    assert store.view().count() == 0 and store.versions() == []
    for step in range(12):
        do = step % 6
        if do in (0, 1, 3):
            rows = [(f"d{rng.randrange(5)}:{rng.randrange(4)}", f"d{rng.randrange(5)}", rng.randrange(100), f"r{step}") for _ in range(8)]
            store.put(spark.createDataFrame(rows + [(None, "x", 1, "y")], "key string, document string, updated long, record string"))
            for k in {r[0] for r in rows}:
                want[k] = max((u, rec, d) for key, d, u, rec in rows if key == k)
        elif do == 2:
            gone = {k for k, (u, rec, d) in want.items() if d == "d1" or k.startswith("d1:")}
            assert store.delete_documents(spark.createDataFrame([("d1",), ("d1",), ("zz",)], "document string")) == len(gone)
            want = {k: v for k, v in want.items() if k not in gone}
        elif do == 4:
            assert store.cleanup(40) == sum(u < 40 for u, *_ in want.values())
            want = {k: v for k, v in want.items() if v[0] >= 40}
        else:
            store.compact()
            assert len(store.versions()) == 1
        assert {r["key"]: (r["updated"], r["record"], r["document"]) for r in store.view().collect()} == want
    (tmp_path / "store/99").mkdir()
    assert {r["key"] for r in store.listed("d2:").collect()} == {k for k in want if k.startswith("d2:")}
    some = sorted(want)[:2]
    assert {r["key"] for r in store.get(spark.createDataFrame([(k,) for k in some + some], "key string")).collect()} == set(some)
    other = Store(spark, str(tmp_path / "other"))
    assert other.copy_from(store) == len(want) == other.view().count()


def test_folders_of_json(spark, tmp_path):
    texts = {"s-1.json": {"key": "a:1", "documentKey": "a", "updatedAt": 5, "pages": ["x"]}, "s-2.json": {"key": "b", "pages": []}, "s-3.json": {"pages": []}, "s-4.json": {"key": "c", "pages": 4}, "t-5.json": {"key": "d", "pages": []}}
    for name, x in texts.items():
        (tmp_path / name).write_text(json.dumps(x, indent=1))
    (tmp_path / "s-6.json").write_text('{"key": "e", "pages": [')
    (tmp_path / "s-7.txt").write_text("{}")
    good, aside = read_folder(spark, str(tmp_path), "s-")
    assert sorted((r["key"], r["document"], r["updated"]) for r in good.collect()) == [("a:1", "a", 5), ("b", None, 0)]
    assert {r["file"] for r in aside.collect()} == {"s-3.json", "s-4.json", "t-5.json", "s-6.json"}
    store = Store(spark, str(tmp_path / "store"))
    store.put(good)
    assert json.loads(store.view().where(F.col("key") == "a:1").first()["record"])["pages"] == ["x"]

"""Helpers that the operators share."""

import pytest
from pyspark.sql import functions as F

from casegrain.llm import common


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    rows = spark.createDataFrame([("hot", k) for k in range(60)] + [(f"c{k % 7}", k) for k in range(40)], "key string, n int")
    facts = rows.groupBy("key").agg(F.max("n").alias("most"), F.count("*").alias("rows"))
    got = common.hot_join(rows, facts, ["key"], "rows")
    assert got.columns == ["key", "n", "most"]
    want = {r.key: r.most for r in facts.collect()}
    found = got.collect()
    assert len(found) == 100 and sorted((r.key, r.n) for r in found) == sorted((r.key, r.n) for r in rows.collect()) and all(r.most == want[r.key] for r in found)
    assert common.hot_join(rows.where("1 = 0"), facts.where("1 = 0"), ["key"], "rows").count() == 0


def test_free_name(spark):
    df = spark.range(1).selectExpr("1 as key_0", "2 as KEY_1", "3 as other")
    assert common.free_name(df, "key") == "key_2" and common.free_name(df, "own") == "own_0"


def test_row_names_tell_null_from_text(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "b"), (11, None), (1, None), (None, "")], "doc_id bigint, text string")
    names = [r.n for r in rows.select(common.row_name(F.col("doc_id"), common.text_sha()).alias("n")).collect()]
    assert len(set(names)) == 6


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Flag:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"
        getConf = Conf  # noqa: N815
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(Flag)})())})()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_slices_give_memory_back(monkeypatch):
    import pyarrow as pa

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "c"]})
    found = [(b.num_rows, len(given)) for b in common.sized_slices([batch], "text", 10)]
    assert [n for n, _ in found] == [2, 1, 1] and [k for _, k in found] == [0, 1, 2] and len(given) == 3

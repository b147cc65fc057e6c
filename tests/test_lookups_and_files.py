"""Readers, writers and lookups that no registered query runs, on rows worked out by hand."""

import gzip

import pytest
from pyspark.sql import functions as F

from casegrain.functions import text as S
from casegrain.operators import assets as X
from casegrain.operators import credit as C
from casegrain.operators import joins as J
from casegrain.operators import ontology as O
from casegrain.operators import outcomes as P
from casegrain.operators import taxonomy as T
from casegrain.operators import windows as N
from casegrain.sources import readers as R
from casegrain.sources import writers as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_text_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.rrf.gz", "wt") as f:
        f.write("# a comment\nC1|one|N\nC2|two|Y\nC3|three|\n")
    assert rows(R.piped(spark, str(tmp_path / "a.rrf.gz"), ["cui", "name", "suppress"], "suppress").select("cui")) == [("C1",), ("C3",)]
    assert R.piped(spark, str(tmp_path / "a.rrf.gz"), ["cui", "name", "suppress"]).count() == 3
    (tmp_path / "b.csv").write_text('id,text\n1,"says ""no"", twice"\n2,\n')
    assert rows(R.headed_csv(spark, str(tmp_path / "b.csv"))) == [("1", 'says "no", twice'), ("2", None)]
    (tmp_path / "c.jsonl").write_text('{"case_id": "1", "predicted": " gout ", "gold": "g"}\n{"case_id": "2", "pred": "", "predicted_diagnosis": "x", "ground_truth": "y"}\n')
    assert rows(R.name_pairs(spark, str(tmp_path / "c.jsonl"))) == [("1", "gout", "g"), ("2", "x", "y")]
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(R.rows(spark, str(tmp_path / "d.jsonl"), "a int")) == [(1,), (2,)]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n{"a": oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.rows(spark, str(tmp_path / "e.jsonl"), "a int").collect()


def test_cached_lookup(spark):
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    cache = spark.createDataFrame([("a", "long name", 1), ("a", "abc", 2), ("a", "abd", 0)], "term string, display string, ord int")
    assert rows(R.cached_lookup(terms, cache, ["term"], 2).select("term", "display", "place")) == [("a", "abc", 1), ("a", "abd", 2), ("b", None, 1)]
    assert rows(R.cached_lookup(terms, cache, ["term"], 1, by_length=False).select("term", "display")) == [("a", "abd"), ("b", None)]


def test_written_blocks(spark, tmp_path):
    records = spark.createDataFrame([("1", "gout"), ("2", "flu"), ("3", "x")], "id string, answer string")
    blocks = spark.createDataFrame([("1", 3, 0.9), ("2", 1, 0.8)], "id string, graders int, fused_reward double")
    assert rows(W.merged_blocks(records, blocks, "id", 2).select("id", "fused_reward")) == [("1", 0.9), ("2", None), ("3", None)]
    gold = spark.createDataFrame([("1", "gout"), ("2", "cold")], "id string, gold string")
    path = str(tmp_path / "scored")
    assert W.backfill(records, gold, "id", path, S.same_name("gold", "answer")) == {"records": 3, "scored": 2, "unmatched": 1}
    assert rows(spark.read.parquet(path).select("id", "score")) == [("1", 1.0), ("2", 0.0), ("3", None)]
    W.small_csv(records, str(tmp_path / "csv"), ["answer"])
    assert rows(R.headed_csv(spark, str(tmp_path / "csv"))) == rows(records)
    assert T.markdown(records.orderBy("id").limit(1)) == "| id | answer |\n| - | - |\n| 1 | gout |"
    with pytest.raises(ValueError):
        T.markdown(records, 2)


def test_asset_lookups(spark):
    items = spark.createDataFrame([("c", "i1"), ("c", "i2"), ("c", None), ("d", "i1")], "case_id string, image_id string")
    images = spark.createDataFrame([("c", "i1"), ("c", "i1"), ("d", "i9")], "case_id string, image_id string")
    assert rows(X.imaged_items(items, images, "case_id")) == [("c", "i1")]
    records = spark.createDataFrame([("c", "r1", "Lab", "Blood", True, True), ("c", "r2", "Lab", "Blood", True, False), ("c", "r3", "Lab", "Urine", True, True)], "case_id string, rid string, l1 string, category string, returned boolean, verified boolean")
    asked, menu = spark.createDataFrame([("c", "blood test")], "case_id string, item string"), spark.createDataFrame([("blood test", "Lab", "Blood")], "item string, l1 string, category string")
    assert rows(X.menu_records(asked, menu, records, "case_id").select("rid")) == [("r1",), ("r2",)]
    released = spark.createDataFrame([("c", "r3")], "case_id string, rid string")
    assert rows(X.pending_consults(records, released, "case_id", F.col("l1") == "Lab").select("rid")) == [("r1",)]
    assert rows(spark.createDataFrame([("rule: too long; more",), ("other clause. more",), (None,)], "r string").select(X.terse(F.col("r"), [("rule:", "a rule")], 8))) == [("",), ("a rule",), ("other cl",)]


def test_small_lookups(spark):
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "k string, at int, v string")
    assert rows(J.latest_first(log, "k", "at").select("k", "v")) == [("a", "new"), ("b", "only")]
    dim = spark.createDataFrame([("a", 1.0)], "k string, price double")
    assert rows(J.total_lookup(log.where("k = 'a'"), dim, ["k"]).select("at", "price")) == [(1, 1.0), (2, 1.0)]
    with pytest.raises(KeyError):
        J.total_lookup(log, dim, ["k"])
    adv = spark.createDataFrame([(1.0, 0.5)], "adv_episode double, adv_step double")
    assert C.joint_advantage(adv, 2.0).first().adv == 2.0
    reward, penalty = C.local_penalty(F.col("adv_step") - 1, F.lit(True))
    assert rows(adv.select(reward, penalty)) == [(0.0, -0.1)]
    assert spark.range(1).select(N.inverse(F.create_map(F.lit("a"), F.lit("b"))).alias("m")).first().m == {"b": "a"}
    assert rows(spark.createDataFrame([("é",), (None,)], "t string").select(S.nfkd("t"))) == [("é",), (None,)]
    gates = "array<struct<gate:struct<verdict:string,gt_mismatch:boolean>>>"
    turns = spark.createDataFrame([([(("pass", False),), (None,)],), ([(("pass", True),)],), ([(("mismatch", True),)],), (None,)], f"turns {gates}")
    assert [r[0] for r in turns.select(P.passed_corrupt(F.col("turns"))).collect()] == [False, True, False, False]


def test_ontology_heads(spark):
    terms = spark.createDataFrame([("gout with tophi, chronic",), ("gout",), ("with tophi",)], "t string")
    assert [r[0] for r in terms.select(O.head_term(F.col("t"), [" with ", ", "])).collect()] == ["gout", "gout", "with tophi"]
    first = spark.createDataFrame([("a", "b", "NONE", "high", 0.0), ("c", "d", "FULL", "high", 1.0), ("e", "f", "UNKNOWN", "none", None)], "a string, b string, verdict string, confidence string, weight double")
    heads = spark.createDataFrame([("a", "b", "FULL", "high"), ("c", "d", "FULL", "high"), ("e", "f", "NONE", "high")], "a string, b string, head_verdict string, head_confidence string")
    assert rows(O.with_heads(first, heads)) == [("a", "b", "CORE", "medium", 0.85), ("c", "d", "FULL", "high", 1.0), ("e", "f", "UNKNOWN", "none", None)]
    parents = spark.createDataFrame([("x", "p"), ("y", "p"), ("x", "SUB"), ("y", "SUB"), ("p", "DIS"), ("z", "p")], "child string, parent string")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    assert rows(O.typed_siblings(pairs, parents, "SUB", "DIS")) == [("x", "y", "p")]


def test_ancestors_of_a_diamond(spark):
    """Ten diamonds on top of each other have 2^10 paths and 30 ancestors."""
    edges = [e for k in range(10) for e in ((f"n{k}", f"l{k}"), (f"n{k}", f"r{k}"), (f"l{k}", f"n{k + 1}"), (f"r{k}", f"n{k + 1}"))]
    parents = spark.createDataFrame([*edges, ("n10", "n9")], "child string, parent string")
    got = {r.ancestor: r.depth for r in O.ancestors(spark.createDataFrame([("n0",), ("n0",)], "cid string"), parents, 6).collect()}
    assert got == {"l0": 1, "r0": 1, "n1": 2, "l1": 3, "r1": 3, "n2": 4, "l2": 5, "r2": 5, "n3": 6}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert rows(O.ancestors(spark.createDataFrame([("a",)], "cid string"), loop, 4)) == [("a", "a", 2), ("a", "b", 1)]


def test_candidates_by_rare_tokens(spark):
    names = {"c1": "red big bolt", "c2": "red big nut", "c3": "red bolt", "c4": "big bolt red steel", "c5": "green"}
    tokens = spark.createDataFrame([(c, t) for c, n in names.items() for t in n.split()], "cid string, tok string")
    concepts = spark.createDataFrame(list(names.items()), "cid string, label string")
    terms = spark.createDataFrame([("red bolt",), ("Steel",), ("no such thing",), ("red big nut extra",)], "term string")
    assert rows(O.having_all(terms, tokens)) == [("Steel", "c4"), ("red bolt", "c1"), ("red bolt", "c3"), ("red bolt", "c4")]
    assert rows(O.best_covering(terms, tokens, concepts)) == [("Steel", "c4"), ("red big nut extra", "c2"), ("red bolt", "c3")]

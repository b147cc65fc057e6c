"""Every query with SQL gives the SQL's rows on the small tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from casegrain.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return str([str(x) for x in v])
    if not hasattr(v, "__float__"):
        return str(v)
    return repr(round(float(v), 5) + 0.0)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).limit(5).count() > 0


def test_stream_equals_batch_fold(spark):
    a = {r.task: r for r in QUERIES["ewma_fold"](spark, DIR).collect()}
    b = {r.task: r for r in QUERIES["stream_ingest"](spark, DIR).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k].s - b[k].s) < 1e-6 and abs(a[k].mastery - b[k].mastery) < 1e-6 and a[k].visits == b[k].visits


@pytest.mark.parametrize("name", ["concept_ladder", "label_ladder"])
def test_ladders_take_every_name(spark, tmp_path, name):
    parts = [(k, f"red{k} blue{k}", f"kind{k}") for k in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.term: (r.cid, r.match) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    if name == "concept_ladder":
        want = {n.upper(): (f"p{k}", "exact_title") for k, n, _ in parts} | {f"{n} {t}": (f"p{k}", "synonym_title") for k, n, t in parts}
    else:
        want = {n.upper(): (f"p{k}", "label") for k, n, _ in parts}
    assert got == want


def test_parse_replies_takes_whole_texts(spark, tmp_path):
    import unicodedata

    texts = ["é ﬁne " * 30, 'says "no" } { \\ and\nmore ' * 5 + "end ²", "", None]
    rows = [(k, 1, "assistant", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n, r.nfkc) for r in QUERIES["parse_replies"](spark, str(tmp_path)).collect()}
    nfkc = lambda t: t if t is None else unicodedata.normalize("NFKC", t)
    assert got == {k: (None if t is None else "1", nfkc(t)) for k, t in enumerate(texts)}

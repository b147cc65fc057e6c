"""Hand-checked rows for operators that the tables don't exercise."""

import collections
import json
import math

import pytest
from pyspark.sql import functions as F

from casegrain.functions import numeric as M
from casegrain.functions import text as S
from casegrain.operators import credit as C
from casegrain.operators import curriculum as U
from casegrain.operators import joins as J
from casegrain.operators import judging as G
from casegrain.operators import ontology as O
from casegrain.operators import outcomes as P
from casegrain.operators import planner as N
from casegrain.sources import readers as R
from casegrain.sources import writers as W
from casegrain.streaming import feed as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if hasattr(v, "cast") else F.lit(v))
    return df.select(column.alias("v")).first().v


def test_match_scores(spark):
    score = lambda gt, pred, f, c, p: one(spark, G.level_scores(*map(F.lit, (gt, pred, f, c, p)))["t_reward"])
    assert score(1, 1, 1, 0, 0) == 1 and score(0, 0, 0, 0, 0) == 1
    assert abs(score(1, 2, 1, 0, 0) - 0.769231) < 1e-6 and abs(score(2, 1, 0, 0, 1) - 0.294118) < 1e-6 and abs(score(2, 3, 1, 1, 0) - 0.804348) < 1e-6
    with pytest.raises(Exception, match="more matches"):
        score(1, 1, 2, 0, 0)


def price(spark, **given):
    base = {"kind": "dx", "subkind": None, "score": 0.0, "workup_turns": 1, "channel": None, "exposed": False, "passed": False, "coverage": 1.0, "armed": False, "bound": False, "expected": 0, "task_kind": None, "specificity": None}
    mode = given.pop("mode", None)
    return one(spark, P.terminal_price({k: F.lit(v) for k, v in (base | given).items()}, {"blind_cap_mode": mode} if mode else None))


def test_price_board(spark):
    assert price(spark, workup_turns=0) == -0.05 and price(spark, workup_turns=3) == 0.0
    assert abs(price(spark, score=1.0, coverage=0.25) - 0.55) < 1e-9
    assert price(spark, score=1.0, armed=True) == 0.4 and price(spark, score=1.0, armed=True, expected=2, mode="incomplete_coverage") == 1.0
    assert price(spark, score=1.0, channel="text") == 0.0 and price(spark, score=1.0, exposed=True, passed=True) == -0.1
    assert [price(spark, kind="defer_mismatch", subkind=s) for s in ("exact", "partial", None)] == [0.9, 0.65, -0.1]
    assert price(spark, kind="defer_ook", task_kind="ook") == 0.4 and price(spark, kind="defer_ook", task_kind="answer") == -0.05
    assert price(spark, kind="format_failure") == -0.1
    with pytest.raises(Exception, match="task kind"):
        price(spark, kind="defer_ook")
    with pytest.raises(ValueError):
        P.check_prices({"ook": 0.95})
    assert P.contract(P.PRICES) == "fm-0.10_fo-0.05_zw-0.05_ff-0.10_wv-0.10"


def test_outcomes(spark):
    axes = "array<string>"

    def kind(final, gate=None):
        f = F.struct(*[F.lit(final.get(k)).cast("boolean" if k == "gate" else "string").alias(k) for k in ("kind", "source", "diagnosis", "gate", "reason")])
        g = F.struct(F.lit((gate or {}).get("gt_mismatch")).cast("boolean").alias("gt_mismatch"), F.array(*map(F.lit, (gate or {}).get("axes", []))).cast(axes).alias("axes"), F.array(*map(F.lit, (gate or {}).get("gt_axes", []))).cast(axes).alias("gt_axes"))
        return tuple(one(spark, P.outcome(f, g)))

    dx = {"kind": "final_diagnosis", "source": "model"}
    assert kind(dx | {"diagnosis": "Fabry disease"}) == ("dx", None)
    assert kind(dx | {"diagnosis": "Unknown | x"}) == ("defer_ook", None)
    assert kind({"kind": "final_diagnosis", "diagnosis": "undetermined", "source": "synthesized"}) == ("format_failure", None)
    assert kind({"kind": "defer", "gate": True}, {"gt_mismatch": False}) == ("defer_mismatch", None)
    assert kind({"kind": "defer", "gate": True}, {"gt_mismatch": True, "axes": ["modality"], "gt_axes": ["modality", "anatomy"]}) == ("defer_mismatch", "exact")
    assert kind({"kind": "defer", "gate": True}, {"gt_mismatch": True, "axes": [], "gt_axes": ["modality"]}) == ("defer_mismatch", "partial")
    assert kind({"kind": "defer", "reason": "Mismatch — wrong test"}) == ("defer_mismatch_claimed", None)
    assert kind({"kind": "defer", "reason": "out_of_knowledge — rare"}) == ("defer_ook", None)
    assert one(spark, P.claim_specificity(F.lit("mismatch: wrong test"), S.strings(["modality", "anatomy"]), F.lit(True))) == "exact"


@pytest.mark.parametrize(
    "totals, mode, want",
    [
        ([0.9] * 4 + [0.0] * 5, "mean_std", (1.054093, -0.843274)),
        ([1.0] * 8 + [0.891], "mean", (0.012111, -0.096889)),
        ([1.0] * 8 + [0.891], "mean_std_floor", (0.121111, -0.968889)),
        ([1.0] * 8 + [0.7], "mean_std", (0.333333, -2.666667)),
        ([1.0], "mean_std", (0.0, 0.0)),
    ],
)
def test_group_advantage(spark, totals, mode, want):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(totals)], "g string, traj int, total double")
    got = [r.adv_episode for r in C.episode_advantage(df, "g", "total", mode).orderBy("traj").collect()]
    assert abs(got[0] - want[0]) < 1e-6 and abs(got[-1] - want[1]) < 1e-6


def test_returns(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, -0.1), (0, 2, 1.0)], "e int, t int, r double")
    assert [round(x.ret, 6) for x in C.discounted(df, ["e"], "t", "r", 0.99).orderBy("t").collect()] == [0.8811, 0.89, 1.0]


def test_visit_and_fold(spark):
    df = spark.createDataFrame([("a", 1, x) for x in (1.0, 0.5, 1.0)], "task string, step int, share double")
    v = U.visit_stats(df, ["task", "step"], "share", 0.75)
    r = v.first()
    assert abs(r.mean_share - 0.833333) < 1e-6 and abs(r.std_share - 0.235702) < 1e-6
    state = U.folded(v, U.Sampler(gamma=0.9)).first()
    assert (state.s, state.f) == (4.7, 2.8)
    assert U.folded(v.union(v), U.Sampler(gamma=0.9)).first().s == 4.7


def test_lineage_phases_quotas(spark):
    steps = spark.createDataFrame([(5,), (10,), (25,)], "s int")
    assert [r.generation for r in J.as_of(steps, F.col("s"), spark, [(0, 0), (10, 1), (20, 2)]).orderBy("s").collect()] == [0, 1, 2]
    assert J.phase_bounds([0.5, 0.5], 10, 100) == [(0, 50), (50, 100)]
    assert one(spark, M.ramp(F.lit(50), 200, 0.3, 0.4, 0.5)) == pytest.approx(0.35)
    assert U.quotas(10, {"a": 0.55, "b": 0.45}) == {"a": 6, "b": 4} and U.quotas(10, {"b": 0.45, "a": 0.55}) == {"a": 5, "b": 5} and U.quotas(7, {"a": 1, "b": 1, "c": 1}) == {"a": 3, "b": 2, "c": 2}
    caps = {"max_asks": 1, "max_workup_turns": 1, "max_searches": 0}
    with pytest.raises(ValueError):
        U.Schedule([caps], [0.5], 5, 4, caps)


def test_as_of_join_of_tables(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("m", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 4, "b")], "k string, since int, v string")
    assert [tuple(r) for r in J.as_of_join(left, right, ["k"], "t", "since", ["v"]).orderBy("k", "t").collect()] == [("k", 1, None), ("k", 5, "b"), ("m", 3, None)]


def test_greedy_lines(spark):
    s = "array<struct<name:string,category:string,asset:string>>"
    lines, recs = F.from_json(F.lit(json.dumps([dict(name="x", category="c", asset="1"), dict(name="x", category="c", asset="2"), dict(name="q", category="z", asset="1")])), s), F.from_json(F.lit(json.dumps([dict(name="x", category="c", asset="1"), dict(name="y", category="c", asset="2")])), s)
    assert one(spark, J.greedy_lines(lines, recs)) == [0, 1, -1]


def test_ancestors_and_relations(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d")], "child string, parent string")
    got = {(r.ancestor, r.depth) for r in O.ancestors(spark.createDataFrame([("a",)], "cid string"), edges).collect()}
    assert got == {("b", 1), ("e", 1), ("c", 2), ("d", 2)}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert {(r.ancestor, r.depth) for r in O.ancestors(spark.createDataFrame([("a",)], "cid string"), loop).collect()} == {("b", 1), ("a", 2)}
    pairs = spark.createDataFrame([("a", "c"), ("b", "e"), ("a", "a"), ("a", None)], "a string, b string")
    assert {(r.a, r.b): r.relation for r in O.relations(pairs, edges).collect()} == {("a", "c"): "a_subtype_of_b", ("b", "e"): "distant", ("a", "a"): "equivalent", ("a", None): "unmapped"}


def test_resolve_ladder(spark):
    raw = spark.createDataFrame([("s", "1", "Cushing's disease", "pref", 0), ("s", "1", "pituitary cushing", "synonym", 1), ("s", "2", "Carcinoma of lung", "pref", 0), ("s", "2", "A growth in the bronchial wall tissue", "def", 1)], "src string, cid string, name string, kind string, ord int")
    tables = O.build(raw, spark.createDataFrame([], "src string, child string, parent string"))
    terms = spark.createDataFrame([("CUSHING'S DISEASE",), ("Cushing disease",), ("pituitary cushings",), ("lung carcinomas",), ("bronchial wall",)], "term string")
    got = {r.term: (r.cid, r.match) for r in O.resolve(terms, tables).collect()}
    assert got["CUSHING'S DISEASE"] == ("1", "exact_title") and got["Cushing disease"] == ("1", "normalized_title")
    assert got["lung carcinomas"] == ("2", "top_hit_fuzzy") and got["bronchial wall"] == ("2", "def_mention")
    assert one(spark, O.head_term(F.lit("Median ligament syndrome complicated by pain"), [" due to ", " complicated by ", ","])) == "Median ligament syndrome"


def test_text(spark):
    assert one(spark, S.normalize(F.lit("Type-I,  Fabry "))) == "type i fabry" and one(spark, S.normalize(F.lit(None))) == ""
    assert one(spark, S.lexical_match(F.lit("Fabry disease"), F.lit("fabry"))) == 1.0 and one(spark, S.lexical_match(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, S.strip_hedges(F.lit("Most likely: lupus?"))) == "lupus"
    assert one(spark, S.singular(F.lit("carcinomas"))) == "carcinoma" and one(spark, S.singular(F.lit("loss"))) == "loss"
    assert one(spark, S.tagged(F.lit("so [diagnosis: Gout ] x"), "DIAGNOSIS")) == "Gout" and one(spark, S.tagged(F.lit("none"), "DIAGNOSIS", strict=True)) is None
    assert one(spark, S.first_object(F.lit('a {"x": "}", "y": {"z": 1}} b'))) == '{"x": "}", "y": {"z": 1}}'
    assert tuple(one(spark, S.ask_shape(F.lit("Any pain (e.g. chest.)? Since when?")))) == (2, 2)
    assert one(spark, S.close_match(["modality", "anatomy"])(F.lit("modalty"))) == "modality"
    g = one(spark, S.gate_reply(F.lit("<reasoning>r</reasoning><action>gate_verdict: mismatch — modality; reason: wrong scan</action>")))
    assert (g.think, g.verdict, g.axes, g.reason, g.error) == ("r", "mismatch", ["modality"], "wrong scan", None)
    assert one(spark, S.nfkc(F.lit("ﬁ"))) == "fi"


def test_agreement_edges(spark):
    empty = spark.createDataFrame([], "x int, y int")
    assert tuple(empty.agg(M.pearson("x", "y"), M.kappa("x", "y")).first()) == (0.0, 0.0)
    same = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    assert tuple(same.agg(M.pearson("x", "y"), M.kappa("x", "y")).first()) == (0.0, 1.0)


def test_match_and_floor(spark):
    m = F.from_json(F.lit('[{"level":"core","gt":1,"pred":1},{"level":"full","gt":1,"pred":2},{"level":"partial","gt":2,"pred":1}]'), "array<struct<level:string,gt:int,pred:int>>")
    assert [tuple(x) for x in one(spark, G.best_matches(m, F.lit(2)))] == [("full", 1, 2), ("partial", 2, 1)]
    up = lambda levels, floor: one(spark, G.raise_levels(S.strings(levels), F.lit(floor).cast("string"), F.lit(False)))
    assert up(["partial", "full"], "core") == ["core", "full"] and up([], "core") == ["core"] and up(["partial"], None) == ["partial"]


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path / "cache.jsonl")
    with open(p, "w") as f:
        f.write('{"k": "a", "v": 1}\nnot json\n{"k": "a", "v": 2}\n\n{"k": "b", "v": 3}\n')
    assert {(r.k, r.v) for r in R.replayed_cache(spark, p, "k string, v int", "k").collect()} == {("a", 2), ("b", 3)}
    obo = tmp_path / "o.obo"
    obo.write_text('format: 1\n\n[Term]\nid: X:1\nname: one\nsynonym: "uno" EXACT []\nis_a: X:2 ! two\n\n[Term]\nid: X:2\nname: two\n\n[Term]\nid: X:3\nname: old\nis_obsolete: true\nreplaced_by: X:2\n')
    t = R.stanzas(spark, str(obo))
    assert {(r.cid, r.name) for r in t["names"].collect()} == {("X:1", "one"), ("X:1", "uno"), ("X:2", "two"), ("X:2", "old")}
    assert [tuple(r) for r in t["parents"].collect()] == [("X:1", "X:2")]
    owl = tmp_path / "o.owl"
    owl.write_text('<r><owl:Class rdf:about="http://x/A_1"><rdfs:label>one</rdfs:label><rdfs:subClassOf rdf:resource="http://x/A_2"/></owl:Class><owl:Class rdf:about="http://x/A_3"/></r>')
    t = R.xml_classes(spark, str(owl))
    assert [tuple(r) for r in t["parents"].collect()] == [("A_1", "A_2")] and [r.name for r in t["names"].collect()] == ["one"]
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert W.replace(spark.read.parquet(path).where("id > 0"), path, 2) == 2 and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        W.replace(spark.range(1), path, 5)
    cases = spark.createDataFrame([("c", json.dumps({"History": [{"fact_id": "1", "atomic_fact": "x"}], "Social": {"fact_id": "2", "atomic_fact": "y"}}), json.dumps([{"test_name": "CBC"}]))], "case_id string, examination string, lab string")
    assert {(r.section, r.fact_id) for r in R.episode_facts(cases).collect()} == {("History", "1"), ("Social", "2")}
    assert [(r.rid, r.test_name, r.section) for r in R.episode_records(cases, ["lab"]).collect()] == [(0, "CBC", "lab")]


def test_stream_guards(spark):
    calls = spark.createDataFrame([(1, False, False), (2, True, False)], "step int, fallback boolean, flagged boolean")
    with pytest.raises(RuntimeError):
        T.halt_when(calls)
    T.halt_when(calls.where("step = 1"))
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", 1.0)], "k string, score double")
    compute = lambda m: m.withColumn("score", F.lit(0.5)).withColumn("fallback", F.col("k") == "c")
    every, fresh = T.served(keys, cache, "k", compute)
    assert sorted((r.k, r.source) for r in every.collect()) == [("a", "cache"), ("a", "cache"), ("b", "computed"), ("c", "fallback")]
    assert [r.k for r in fresh.collect()] == ["b"]


def test_draws():
    w = {"a": 1.0, "b": 0.0, "c": 2.0}
    assert sorted(U.draw(U.seeded(1, 2), w, 5, 0.5)) == ["a", "b", "c"] and U.draw(U.seeded(1), w, 2, 0.1) == U.draw(U.seeded(1), w, 2, 0.1)
    assert math.isclose(U.seeded("abc").random(), U.seeded("abc").random())


def tasks_of(n, kinds=N.KINDS, **more):
    return [
        {"task": f"{c}:{k}", "case": str(c), "kind": k, "horizon": 1 + c % 3, "rung": c % 9, "visits": 0, "last_visit": c % 5, "ema_std": None if c % 2 else c / n, "m0": 0.6, "mastery": 0.1 * (c % 10),
         "retired": c % 10 == 9, "shelved": c % 10 == 8, "need_workup": c % 4, "need_searches": c % 2, "difficulty": ""} | more
        for c in range(n) for k in kinds
    ]


def course_of(per_step=6, steps=3, **more):
    caps = [{"max_asks": 2, "max_workup_turns": 3, "max_searches": 0}, {"max_asks": 4, "max_workup_turns": 6, "max_searches": 1}]
    sampler = U.Sampler(**{k: more.pop(k) for k in list(more) if hasattr(U.Sampler, k)})
    return N.Course(U.Schedule(caps, [0.5, 0.5], steps, per_step, caps[-1], sampler), 60, 7, **more)


TASKS = "task string, case string, kind string, horizon int, rung int, visits int, last_visit int, ema_std double, m0 double, mastery double, retired boolean, shelved boolean, need_workup int, need_searches int, difficulty string"


@pytest.mark.parametrize("way", ["pool", "table"])
def test_plan_keeps_its_rules(spark, way):
    course, pool = course_of(12, 5, replay=0.1, max_visits=2), tasks_of(200)
    if way == "pool":
        header, visits = N.plan_pool(course, 8, pool)
        assert (header, visits) == N.plan_pool(course, 8, pool[::-1])
    else:
        table = spark.createDataFrame(pool, TASKS)
        header, visits = N.plan_table(course, 8, table.repartition(3))
        assert (header, visits) == N.plan_table(course, 8, table.repartition(2))
    by = {t["task"]: t for t in pool}
    kinds = collections.Counter(v["kind"] for v in visits if not v["replay"])
    assert kinds == U.quotas(54, course.shares(40)) and sum(v["replay"] for v in visits) == 6 == header["replay"]
    assert header["steps"] == [40, 45] and header["phase"] == 2 and header["short"] == 0 and max(map(abs, header["quota_deviation"].values())) < 0.02
    assert collections.Counter(v["step"] for v in visits) == dict.fromkeys(range(40, 45), 12)
    assert all(n == 1 for n in collections.Counter((v["step"], v["case"]) for v in visits).values())
    assert max(collections.Counter(v["task"] for v in visits).values()) <= 2
    for v in visits:
        t = by[v["task"]]
        assert t["horizon"] <= 2 and not t["shelved"] and t["retired"] == v["replay"]
        assert 3 <= v["max_asks"] <= 4 and 4 <= v["max_workup_turns"] <= 6 and v["max_searches"] == 1 and v["r_ook"] == 0.4
        assert (v["corrupt_rate"], v["corrupt_seed"] != "0") == (float(v["kind"] == "corrupt"), v["kind"] == "corrupt")
    live = [t for t in pool if t["horizon"] <= 2 and not t["retired"] and not t["shelved"]]
    assert header["admitted"] == len(live) and header["frac_mastered"] == round(sum(t["mastery"] >= 0.7 for t in live) / len(live), 4)


@pytest.mark.parametrize("way", ["pool", "table"])
def test_plan_tops_up(spark, way):
    pool = tasks_of(3, ("answer",), retired=False, horizon=1) + tasks_of(20, ("corrupt",), retired=False, horizon=1, shelved=False)
    course = course_of(8, 2, fixed_shares={"answer": 0.9, "corrupt": 0.1, "ook": 0.0}, replay=0.0)
    header, visits = N.plan_pool(course, 0, pool) if way == "pool" else N.plan_table(course, 0, spark.createDataFrame(pool, TASKS))
    for step in (0, 1):
        kinds = collections.Counter(v["kind"] for v in visits if v["step"] == step)
        assert sum(kinds.values()) == 8 and kinds["answer"] <= 3
    assert header["short"] == header["topup"] >= 8 and header["quota_deviation"]["ook"] == 0.0


def test_plan_makes_its_tasks_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(tasks_of(200), TASKS).mapInArrow(count, TASKS)
    _, visits = N.plan_table(course_of(12, 5, replay=0.1, max_visits=2), 8, table)
    assert len(visits) == 60 and made.value == 600


@pytest.mark.parametrize("way", ["pool", "table"])
def test_plan_explores(spark, way):
    """A tenth of a kind's draws, and no more, goes to tasks that weight alone would never take."""
    pool = tasks_of(60, ("answer",), retired=False, shelved=False, horizon=1, last_visit=10**6)
    for k, t in enumerate(pool):
        t["ema_std"] = 1.0 if k < 25 else 0.0
    heavy = {t["task"] for t in pool[:25]}
    course = course_of(10, 40, fixed_shares={"answer": 1.0}, replay=0.0, rho=0.0, eps_uniform=0.2, beta_r=0.02)
    _, visits = N.plan_pool(course, 0, pool) if way == "pool" else N.plan_table(course, 0, spark.createDataFrame(pool, TASKS))
    light = sum(v["task"] not in heavy for v in visits)
    # two of ten draws are uniform, 35 of 60 tasks are light; the other eight take the first ranks
    assert len(visits) == 400 and 25 <= light <= 70


def test_native_draw_follows_its_weights(spark):
    rows = [(f"s{k}", c, 5.0 if c == 0 else 1.0 if c < 6 else 0.0) for k in range(3000) for c in range(8)]
    table = spark.createDataFrame(rows, "stratum string, task int, weight double")
    found = U.native_draw(table.withColumn("name", F.concat_ws("-", "stratum", "task")), "stratum", "name", "weight", 2, "x").where("place <= 2").groupBy("task", "place").count().collect()
    got = {(r.task, r.place): r["count"] / 3000 for r in found}
    assert got[0, 1] == pytest.approx(0.5, abs=0.03) and got[3, 1] == pytest.approx(0.1, abs=0.02)
    # second of two: 5/10 * 1/5 + 4/10 * ... by the law of drawing without replacement
    assert got[0, 2] == pytest.approx(5 / 10 * 5 / 9, abs=0.03) and got[3, 2] == pytest.approx(0.5 * 1 / 5 + 4 / 10 * 1 / 9, abs=0.02)
    assert not any(t > 5 for t, _ in got)


def test_ratchet_and_shelving(spark):
    p = U.Sampler(ratchet_successes=2, shelve_window=2, rung_gap=2)
    visits = [("a", 1, 0.9, 0.1, 4, 3, [0, 1, 1]), ("a", 2, 0.9, 0.1, 4, 3, [0, 1, 0]), ("a", 3, 0.9, 0.1, 4, 4, [1, 0, 3])]
    visits += [(t, k, 0.0, 0.0, 4, 0, [0, 0, 0]) for t in ("low", "edge") for k in (1, 2)] + [("other", 1, 1.0, 0.0, 1, 1, [1, 0, 0]), ("a", 3, 0.1, 0.1, 4, 0, [9, 9, 9])]
    frame = spark.createDataFrame(visits, "task string, step int, mean_share double, std_share double, n int, successes int, phase_wins array<int>")
    pool = spark.createDataFrame([("a", 3, 4, 0.6), ("low", 8, 4, 0.3), ("edge", 5, 4, 0.3), ("mid", 4, 4, 0.5)], "task string, rung int, horizon int, m0 double")
    got = {r.task: r for r in U.fold_pool(pool, frame.orderBy("n"), p).collect()}
    # two successes within phase 2 at step 2, three within phase 3 change nothing after that
    assert got["a"].horizon == 2 and got["a"].visits == 3 and set(got) == {"a", "low", "edge", "mid"}
    # at step 2 the frontier is the median of a (3) or none, mid (4) and, until they sink, the others
    assert got["low"].shelved and not got["mid"].shelved and got["low"].horizon == 4
    steps = frame.where("task = 'a'").dropDuplicates(["step"]).withColumn("horizon", F.lit(4))
    assert U.folded(steps, p).first().horizon == 2
    with pytest.raises(ValueError):
        U.fold_pool(pool, frame, p, 3)


def test_concepts_of_equal_tokens_are_looked_up_once(spark):
    names = ["red bolt", "blue bolt", "red rings"]
    raw = [("x", f"c{k:03d}", names[k % 3] + ("!" if k == 5 else ""), "pref", 0) for k in range(300)] + [("x", "lone", "odd green nut", "pref", 0)]
    tables = O.build(spark.createDataFrame(raw, "src string, cid string, name string, kind string, ord int"), spark.createDataFrame([], "src string, child string, parent string"))
    terms = spark.createDataFrame([("RED BOLT",), ("green nut",), ("bolt blue big",), ("bolt",), ("ring",), ("none",)], "term string")
    found = O.resolve(terms, tables)
    # the shortest label with all rare tokens, then the least id
    assert {r.term: (r.cid, r.match) for r in found.collect()} == {
        "RED BOLT": ("c000", "exact_title"), "green nut": ("lone", "synonym_title"), "bolt blue big": ("c001", "top_hit_fuzzy"), "bolt": ("c000", "top_hit_fuzzy"), "ring": ("c002", "top_hit_fuzzy"),
    }
    # what grows with the table is not sent to every task
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert O.having_all(terms.where("term = 'RED BOLT'"), tables["tokens"]).count() == 100


def test_pool_of_any_size_is_folded_in_order(spark):
    import random
    import statistics

    rng, p = random.Random(3), U.Sampler(shelve_window=2, shelve_mean=0.5, shelve_std=0.5, retire_window=2, retire_mean=0.7, retire_std=0.4, rung_gap=1)
    pool = [(f"t{k:02d}", rng.randrange(-3, 9), 4, rng.choice([0.1, 0.5, 0.9])) for k in range(60)]
    visits = [(t, step, rng.random(), rng.random() / 2, 4, rng.randrange(5)) for t, *_ in [*pool, ("strange",)] for step in range(12) if rng.random() < 0.7]
    # one by one, the frontier from all states each time
    want = {t: U.new_state(p.nu, m0, h) | {"rung": rung, "shelved": False} for t, rung, h, m0 in pool}
    for t, *visit in sorted(visits, key=lambda v: (v[1], v[0])):
        if t in want:
            x, was = want[t], want[t]["retired"]
            U.fold_visits(x, [tuple(visit)], p)
            live = [y["rung"] for y in want.values() if not y["retired"] and not y["shelved"] and 0.2 <= y["s"] / (y["s"] + y["f"]) <= 0.8] or [y["rung"] for y in want.values()]
            low = len(x["window"]) >= 2 and all(m < 0.5 and d < 0.5 for m, d in x["window"][-2:])
            if low and not was and not x["retired"] and x["rung"] >= statistics.median(live) + 1:
                x["shelved"] = True
    # more tasks than were once folded in one place, all unvisited and beside the frontier
    schema = "task string, rung int, horizon int, m0 double"
    many = spark.range(200_000).select(F.format_string("u%06d", "id").alias("task"), F.lit(0).alias("rung"), F.lit(4).alias("horizon"), F.lit(0.95).cast("double").alias("m0"))
    frame = spark.createDataFrame(visits, "task string, step int, mean_share double, std_share double, n int, successes int").repartition(3)
    got = U.fold_pool(spark.createDataFrame(pool, schema).unionByName(many), frame, p).where("task < 'u'")
    assert {r.task: (r.s, r.f, r.visits, r.retired, r.rung, r.shelved) for r in got.collect()} == {t: (x["s"], x["f"], x["visits"], x["retired"], x["rung"], x["shelved"]) for t, x in want.items()}
    assert 5 < sum(x["shelved"] for x in want.values()) < 55


def test_curriculum_plan_reaches_light_tasks(spark, tmp_path):
    import datetime

    from casegrain.plans.queries import QUERIES

    at = datetime.datetime(2024, 1, 2)
    rows = [(k * 1500 + c, at, c, kind, 50.0) for k, kind in enumerate(("click", "view", "purchase")) for c in range(1500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    plan = QUERIES["curriculum_plan"](spark, str(tmp_path)).collect()
    heavy = {t for kind in ("click", "view", "purchase") for t in sorted(f"{c}:{kind}" for c in range(1500))[:400]}
    assert len(plan) == 80 and any(r.task not in heavy for r in plan)

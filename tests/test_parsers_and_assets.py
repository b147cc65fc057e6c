"""Parsers of model output, served assets and plan recovery."""

import pytest
from pyspark.sql import functions as F

from casegrain.functions import actions as A
from casegrain.functions.text import same_name
from casegrain.operators import assets as X
from casegrain.operators import ontology as O
from casegrain.operators.outcomes import opens_without_diagnosis

VOCABULARY = A.Vocabulary(
    ("Oral, Dental Examination", "Lab/Blood", "Lab/Urine", "Imaging/CT chest", "Imaging/Other", "Lab/Other"), {"heart": ("Imaging/CT chest",)}, {"haematology": "blood"}, ("examination", "test", "of", "the")
)
GRAMMAR = A.Grammar(
    ("ask", "order_tests", "final_diagnosis", "begin_workup", "consult_specialist", "defer_to_human"), {"question": "ask", "diagnose": "final_diagnosis"}, {"order_tests": VOCABULARY}, ("ask", "final_diagnosis"),
    ((r"ask_(?:about|for).*", "ask", ""), (r"consult_(?!specialist)(\w+)", "consult_specialist", r"\1")), ((r"(?:abstain|no diagnosis is possible)\b", "defer_to_human"),),
    {"consult_specialist": {"heart": "cardiology", "": "radiology"}}, ("defer_to_human",),
)


def reply(action):
    return f"<reasoning>why</reasoning><action>{action}</action>"


@pytest.mark.parametrize(
    "action, verb, payload, tags",
    [
        ("ask: any pain?", "ask", "any pain?", []),
        ("Final Diagnosis: gout", "final_diagnosis", "gout", ["spelling"]),
        ("<ask>: x", "ask", "x", ["xml"]),
        ("question: x", "ask", "x", ["alias"]),
        ("ask - any pain", "ask", "any pain", ["dash"]),
        ("final_diagnosis gout", "final_diagnosis", "gout", ["no_colon"]),
        ("final_diagnosi: gout", "final_diagnosis", "gout", ["fuzzy"]),
        ("begin_workup", "begin_workup", "", []),
        ("ask=any pain", "ask", "any pain", ["glued"]),
        ("ask about the pain: where?", "ask", "where?", ["prefix"]),
        ("consult_heart", "consult_specialist", "cardiology", ["prefix", "name"]),
        ("consult_specialist: Radiolgy", "consult_specialist", "radiology", ["name"]),
        ("consult_specialist: radiology", "consult_specialist", "radiology", []),
        ("Abstain since the image is wrong", "defer_to_human", "Abstain since the image is wrong", ["bare"]),
        ('defer_to_human: "no idea"', "defer_to_human", "no idea", ["quotes"]),
    ],
)
def test_actions(action, verb, payload, tags):
    p = GRAMMAR.parse(reply(action))
    assert (p["verb"], p["payload"], p["tags"], p["error"], p["think"]) == (verb, payload, tags, None, "why")


def test_action_errors():
    assert GRAMMAR.parse(None)["error"] == "no reasoning" and GRAMMAR.parse("<reasoning>x</reasoning>")["error"] == "no action"
    assert GRAMMAR.parse(reply("dance: now"))["error"] == "unknown action" and GRAMMAR.parse(reply("ask:"))["error"] == "no payload"
    p = GRAMMAR.parse(reply("order_tests: Oral, Dental Examination, chest, Lab/Blood, nonsense, lab / blood"))
    assert (p["items"], p["dropped"], p["error"], p["tags"]) == (["Oral, Dental Examination", "Imaging/CT chest", "Lab/Blood"], ["nonsense"], None, [])
    p = GRAMMAR.parse(reply("Lab: blood, Urine"))
    assert (p["verb"], p["items"], p["tags"]) == ("order_tests", ["Lab/Blood", "Lab/Urine"], ["level"])
    assert GRAMMAR.parse(reply("order_tests: ,"))["error"] == "empty list" and GRAMMAR.parse(reply("order_tests: xyz"))["error"] == "unknown item"


@pytest.mark.parametrize(
    "item, entries, rule",
    [
        ("lab - blood", ["Lab/Blood"], None), ("chest", ["Imaging/CT chest"], None), ("lab", [], None), ("the heart", ["Imaging/CT chest"], "item_alias"), ("test of urine", ["Lab/Urine"], "item_stopword"),
        ("Imaging/Urine", ["Lab/Urine"], "item_level"), ("other", ["Imaging/Other", "Lab/Other"], "item_level"), ("Lab/other", ["Lab/Other"], None), ("haematology", ["Lab/Blood"], "item_synonym"),
        ("blood and urine", ["Lab/Blood", "Lab/Urine"], "item_split"), ("blood and nonsense", [], None), ("Lab/Uriine", ["Lab/Urine"], "item_fuzzy"), ("", [], None), ("examination", [], None),
    ],
)
def test_vocabulary(item, entries, rule):
    assert VOCABULARY.resolve(item) == (entries, rule)


def test_parsers_as_columns(spark):
    df = spark.createDataFrame([(reply("ask: x"), '```{"gt_count": 2, "pred_count": 1, "matches": [1, 2]}```'), (None, "GT_COUNT: 3\npred_count: 2\nmatched: 2"), ("", "none")], "a string, g string")
    got = df.select(GRAMMAR.column()("a").alias("p"), A.grader_counts("g").alias("c")).collect()
    assert [r.p.verb for r in got] == ["ask", "", ""] and [tuple(r.c) for r in got] == [(2, 1, 1), (3, 2, 2), (1, 1, 0)]
    form = A.surface_form(["repeat", "initial", "on admission"], [("tumour", "tumor")])
    one = spark.createDataFrame([("Repeat, TUMOUR-marker (serum) on admission.",), (None,), ("2×2 grid [a (b] c - initial",), ("Initial repeat",), ("• ﬁne-needle: “x”",)], "t string").select(form("t").alias("f")).collect()
    assert [r.f for r in one] == ["tumor marker", "", "2x2 grid c", "repeat", "fine needle: “x”"]
    names = {
        "CT of a 45-year-old otherwise well man": "CT", "45 year old man": "45 year old man", "MRI brain, from an 8 week old infant (axial)": "MRI brain, (axial)", "Biopsy (3-month-old girl).": "Biopsy",
        "Scan of 2-year-old film": "Scan of 2-year-old film", "Film in 70 years old men with ulcers": "Film with ulcers", "": "", "CT of the head": "CT of the head",
    }
    name = spark.createDataFrame([(k,) for k in names], "t string").select("t", A.without_person(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in name} == names


def test_served_assets(spark):
    items = spark.createDataFrame([("c1", "i1", "1", "f1"), ("c1", "i1", "2", "f1"), ("c2", "i2", "1", "f2"), ("c2", "i2", None, "f2"), ("c3", "i3", "9", "f3")], "case_id string, image_id string, panel_id string, figure_path string")
    manifest = spark.createDataFrame([("i1", "1", "i1#1", "p1", None, None), ("i1", "2", "i1#2", "p2", "i1#g", "g"), ("i2", "1", "i2#1", "gone", None, None)], "image_id string, panel_id string, panel_asset_id string, crop_path string, group_asset_id string, group_crop_path string")
    files = spark.createDataFrame([("p1",), ("p2",), ("g",)], "path string")
    got = {(r.image_id, r.panel_id): (r.status, r.asset_id) for r in X.served_assets(items, manifest, files, True).collect()}
    assert got == {("i1", "1"): ("crop", "i1#1"), ("i1", "2"): ("crop", "i1#g"), ("i2", "1"): ("missing_file", "i2"), ("i2", None): ("no_panel_id", "i2"), ("i3", "9"): ("unbound", "i3")}
    assert {r.asset_id for r in X.served_assets(items, manifest, files, False).where("status <> 'crop'").collect()} == {None}
    assert {r.status for r in X.served_assets(items, None, None, True).collect()} == {"off"}
    assert {r.status: r.n for r in X.status_counts(X.served_assets(items, manifest, files, True)).collect()}["crop"] == 2


def test_validation_and_recovery(spark):
    pool = spark.createDataFrame([("a", "corrupt", None), ("b", None, None)], "case_id string, task_kind string, corrupt_seed string")
    rows = {r.case_id: r for r in X.validation_rows(pool, {"max_asks": 3}, 2).collect()}
    assert (rows["a"].corrupt_seed, rows["a"].corrupt_rate, rows["b"].task_kind, rows["b"].corrupt_seed, rows["b"].max_asks) == ("val-a", 1.0, "answer", "0", 3)
    with pytest.raises(ValueError):
        X.validation_rows(pool, {}, 3)
    plans = spark.createDataFrame([(0, 0, "a", "k"), (1, 5, "b", "k")], "chunk int, step int, case string, contract string")
    assert [r.case for r in X.recovered(plans, 5, 8, "k").collect()] == ["a", "b"]
    for resume, contract in ((11, "k"), (8, "other")):
        with pytest.raises(RuntimeError):
            X.recovered(plans, 5, resume, contract)


def test_episode_metrics(spark):
    turns = spark.createDataFrame([("e", "ask", "history", False, -0.05, None), ("e", "order", "workup", True, 0.1, ["x"]), ("e", "ask", "history", False, 0.0, [])], "e string, verb string, phase string, fallback boolean, reward double, released array<string>")
    r = X.episode_metrics(turns, ["e"]).first()
    assert (r.actions_by_verb, r.turns, r.fallbacks, r.invalid_turns, r.reward_sum, r.reports_released, r.workup_turns) == ({"ask": 2, "order": 1}, 3, 1, 1, 0.05, 1, 1)


def test_scorers_and_guard(spark):
    X.scorer("strict")(same_name)
    df = spark.createDataFrame([("Fabry", "fabry "), ("a", "b")], "g string, a string")
    assert [r.s for r in df.select(X.score_by("strict", F.col("g"), F.col("a")).alias("s")).collect()] == [1.0, 0.0]
    with pytest.raises(KeyError):
        X.score_by("none", F.col("g"), F.col("a"))
    f = F.lit(False)
    score = lambda v, c, d, head=False, floor=False: spark.range(1).select(O.guarded_score(f, f, f, f, F.lit(v), F.lit(c), F.lit(d).cast("int"), F.lit(head), floor).alias("s")).first().s
    assert [score("FULL", "high", None), score("FULL", "low", None), score("CORE", "medium", 2), score("CORE", "low", 3), score("CORE", "low", None, True), score("CORE", "low", None, True, True)] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0]


def test_no_diagnosis(spark):
    texts = ["1) Unknown - more tests", "Fabry disease (less likely lupus)", "insufficient data for a diagnosis", "", "Unclear | lupus", "(a) 2. unknown", "1.", "a unknown", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(opens_without_diagnosis("t", [r"unknown\b", r"insufficient (?:data|information)"]).alias("n"))
    assert [r.n for r in df.collect()] == [True, False, True, False, True, True, False, False, False]


def test_action_faults(spark):
    from casegrain.operators import admissible as Q

    rules = Q.Rules(examinations=("Skin",), tests=("Lab/Blood",), departments=("cardiology",), slot_phrases=("one sentence reason",), max_items=2)
    base = {"verb": None, "payload": None, "items": None, "dropped": None, "phase": "workup", "asks_used": None, "workup_used": 1, "searches_used": None, "must_end": None, "overlap": None, "used": None, "pending": None, "searched": None}
    schema = "verb string, payload string, items array<string>, dropped array<string>, phase string, asks_used int, workup_used int, searches_used int, must_end boolean, overlap double, used array<string>, pending array<string>, searched array<string>"
    cases = [
        ({"verb": "final_diagnosis", "payload": "gout"}, None), ({"verb": "final_diagnosis", "payload": "gout", "workup_used": None}, "workup_too_short"), ({"verb": "final_diagnosis", "payload": "Unclear"}, "no_diagnosis"),
        ({"verb": "order_tests", "items": ["Lab/Blood"], "dropped": ["x"]}, "unknown_category"), ({"verb": "order_tests", "items": ["Physical Examination/Skin"], "used": ["exam:skin"]}, "items_repeated"),
        ({"verb": "physical_examination", "items": ["SKIN"]}, None), ({"verb": "physical_examination", "items": ["Lab/Blood"]}, "unknown_items"), ({"verb": "order_tests"}, "no_items"),
        ({"verb": "defer_to_human", "payload": "mismatch: one-sentence reason"}, "defer_slot_echoed"), ({"verb": "defer_to_human", "payload": "mismatch: wrong side", "must_end": True}, None),
        ({"verb": "consult_specialist", "payload": " Cardiology", "pending": ["cardiology"]}, None), ({"verb": "search", "payload": "Gout", "searched": ["gout"]}, "search_repeated"), ({"verb": "ask", "phase": "history", "payload": "why?"}, None),
    ]
    rows = spark.createDataFrame([{**base, **c} for c, _ in cases], schema)
    assert [r.fault for r in Q.checked(rows, rules).collect()] == [f for _, f in cases]
    lenient = Q.Rules(examinations=("Skin",), tests=("Lab/Blood",), max_items=1, lenient=True)
    some = spark.createDataFrame([{**base, "verb": "order_tests", "items": ["Lab/Blood", "Lab/Blood", "Physical Examination/Skin", "Lab/Urine"], "used": ["exam:skin"], "dropped": ["x"]}, {**base, "verb": "ask"}], schema)
    got = Q.checked(some, lenient).collect()
    assert got[0].kept == ["Lab/Blood"] and [tuple(x) for x in got[0].left_out] == [("Physical Examination/Skin", "used"), ("Lab/Urine", "cap"), ("x", "unknown")] and got[1].kept is None


def test_verdict_ladder(spark):
    from casegrain.operators.judging import verdict_ladder

    rows = [("panel", [1.0, 0.9, 0.2], [1.0, 0.9, 0.9], False, 0.0), ("floor", [0.5, 0.6, 0.7, None], [0.9, 0.9, 0.9], False, 0.0), ("veto", [1.0, 1.0, 1.0], None, True, 0.0), ("thin", [1.0, None, 1.0], None, True, 0.3), ("none", None, None, None, 0.7), ("low", [0.1, 0.2, 0.3, 0.4], [0.1, 0.2, 0.3, 0.4], None, 1.0)]
    got = {r.name: r for r in verdict_ladder(spark.createDataFrame(rows, "name string, scores array<double>, lifted array<double>, veto boolean, fallback double")).collect()}
    assert {n: (r.dx_score, r.source, r.vetoed, r.cached) for n, r in got.items() if n != "none"} == {
        "panel": (1.0, "panel", False, True), "floor": (1.0, "panel", False, True), "veto": (0.5, "panel", True, True), "thin": (0.3, "ontology_fallback", False, False), "low": (0.0, "panel", False, True),
    }
    assert got["floor"].prefusion == 0.6 and got["floor"].fused == 0.9 and got["low"].fused == 0.25 and got["none"].dx_score == 0.7


def test_custom_ids_and_overrides(spark):
    from casegrain.operators import joins as J

    pairs = spark.createDataFrame([("a b",), ("a_b",), ("c",), ("x" * 70,)], "key string")
    replies = spark.createDataFrame([("a_b", "old", 1), ("a_b", "new", 2), ("x" * 64, "long", 1)], "custom_id string, reply string, at int")
    got = {r.key: (r.custom_id, r.shared_id, r.reply) for r in J.by_custom_id(pairs, replies, "key", "at").collect()}
    assert got == {"a b": ("a_b", True, "new"), "a_b": ("a_b", True, "new"), "c": ("c", False, None), "x" * 70: ("x" * 64, False, "long")}
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"d": "5"}, None)], "base map<string,string>, over map<string,string>")
    assert [r.m for r in maps.select(X.overridden(F.col("base"), F.col("over")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"d": "5"}]


def test_replace_and_recover(spark, tmp_path):
    from casegrain.sources import writers as W

    path = str(tmp_path / "t")
    assert W.replace(spark.range(3).coalesce(1), path, 3) == 3 and not W.recover(spark, path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if a publication had stopped between its renames
    assert W.recover(spark, path) and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        W.replace(spark.range(2), path, 5)
    assert W.replace(spark.read.parquet(path).where("id > 0"), path) == 2 and spark.read.parquet(path).count() == 2


def test_aborted_trajectories(spark):
    from casegrain.streaming import feed as T

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "traj string, step int")
    events = spark.createDataFrame([("a", 3)], "traj string, turn int")
    assert [tuple(r) for r in T.drop_aborted(rows, events, "traj", 1).collect()] == [("b", 1)]
    with pytest.raises(RuntimeError):
        T.drop_aborted(rows, events.union(events), "traj", 1)


def test_reply_objects(spark):
    from casegrain.functions import text as S

    replies = ['<think>{"a": 1}</think> so {"b": {"c": "}"}} {"d": 2}', '<THINK>x</THINK>```json\n{"matches": [{"level": "Full", "gt": "g", "pred": "p"}, {"level": " no match "}, {}]}\n```', "{ never closed <think> {}", "<think> open {\"a\": 1}", None, ""]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string").select("k", S.reply_object("r").alias("o"), S.reply_matches("r").alias("m")).orderBy("k").collect()
    assert [r.o for r in got][:1] == ['{"b": {"c": "}"}}'] and [r.o for r in got][2:] == [None] * 4
    assert [tuple(x) for x in got[1].m] == [("Full", "g", "p"), (None, None, None)] and got[0].m is None
    S.assert_no_self_grading(spark.createDataFrame([("org/Model-A",)], "m string"), "m", ["x/model-b"])
    with pytest.raises(ValueError):
        S.assert_no_self_grading(spark.createDataFrame([("org/Model-A",)], "m string"), "m", ["model-a"])


def test_ladder_takes_the_first_of_a_key(spark):
    from casegrain.operators import joins as J

    codes = spark.createDataFrame([("a", "late", 2), ("a", "first", 1), ("b", "only", 1)], "k string, code string, ord int")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    found = {r.x: (r.code, r.method) for r in J.by_ladder(rows, F.col("x"), [(codes, "k", "one"), (codes.drop("ord"), "k", "two")]).collect()}
    assert found == {"a": ("first", "one"), "b": ("only", "one"), "c": (None, None), None: (None, None)}

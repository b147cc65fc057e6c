"""Text parsing, keys and small per-episode operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as M
from ..functions import text as S
from ..operators import assets as X
from ..operators import curriculum as U
from ..operators import ontology as O
from ..operators import outcomes as P
from .credit import turns
from .registry import query, table


@query("""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || '''s ' || p_type || ' (old-one)')), '''s( |$)', ' ', 'g'), '[,.\\-/()]', ' ', 'g'), '\\s+', ' ', 'g')) as folded from part""")
def possessive_fold(spark, d):
    return table(spark, d, "part").select("p_partkey", S.possessive_fold(F.concat("p_name", F.lit("'s "), "p_type", F.lit(" (old-one)"))).alias("folded"))


@query("""with t as (select p_partkey, unnest(regexp_extract_all(lower(p_type || ' glasses brass'), '[a-z0-9]+')) as w from part) select distinct p_partkey, case when w like '%s' and w not like '%ss' and length(w) > 3 then w[1:length(w) - 1] else w end as tok from t""")
def singular_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(S.name_tokens(F.concat("p_type", F.lit(" glasses brass")))).alias("tok"))


@query("""select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then p_brand end), ''), nullif(trim(case when p_partkey % 3 = 1 then '  ' else p_type end), ''), '') as gold from part""")
def first_field(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.when(k % 3 == 0, F.col("p_brand")).alias("a"), F.when(k % 3 == 1, "  ").otherwise(F.col("p_type")).alias("b"))
    return p.select("p_partkey", S.pick_field("a", "b").alias("gold"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then trim(p_name) else trim('so [' || 'x' || '] ' || p_type) end as answer, cast(p_partkey % 2 = 0 as int) as found from part""")
def tagged_answer(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(k, F.when(k % 2 == 0, F.concat(F.lit("so [Diagnosis: "), "p_name", F.lit("] yes"))).otherwise(F.concat(F.lit("so [x] "), "p_type")).alias("t"))
    return t.select("p_partkey", S.tagged("t", "DIAGNOSIS").alias("answer"), S.tagged("t", "DIAGNOSIS", strict=True).isNotNull().cast("int").alias("found"))


@query("""select o_orderkey, lower(list_extract(string_split('org/' || o_orderstatus || '/Model-' || o_orderpriority, '/'), -1)) as model from orders""")
def model_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.model_key(F.concat(F.lit("org/"), "o_orderstatus", F.lit("/Model-"), "o_orderpriority")).alias("model"))


_REPLY = "case l_linenumber % 4 when 0 then 'no tags' when 1 then '<reasoning> r </reasoning><action>gate_verdict: pass</action>' when 2 then '<action>gate_verdict: Mismatch - ' || case when l_partkey % 2 = 0 then 'modality' else 'anatomy' end || '; reason: q' || l_suppkey || '</action>' else '<action>ask: x</action>' end"


@query(f"""select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 4 when 1 then 'pass' when 2 then 'mismatch' else '' end as verdict, case when l_linenumber % 4 = 2 then case when l_partkey % 2 = 0 then 'modality' else 'anatomy' end else '' end as axes,
  case when l_linenumber % 4 = 2 then 'q' || cast(l_suppkey as varchar) else '' end as reason, case l_linenumber % 4 when 0 then 'no action block' when 3 then 'not a gate verdict' end as error from lineitem""")
def gate_replies(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    found = li.withColumn("r", S.gate_reply(F.expr(_REPLY.replace("|| l_suppkey ||", "|| cast(l_suppkey as string) ||"))))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.verdict", F.array_join("r.axes", ",").alias("axes"), "r.reason", "r.error")


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'modality' when p_partkey % 3 = 1 then 'modality,anatomy' else '' end as axes, case when p_partkey % 5 > 0 then case when p_partkey % 3 = 0 then 'exact' else 'partial' end end as specificity from part""")
def claimed_axes(spark, d):
    k = F.col("p_partkey")
    reason = F.when(k % 3 == 0, "Wrong-test served").when(k % 3 == 1, "wrong study type, and wrong site").otherwise("mismatch")
    p = table(spark, d, "part").select(k, reason.alias("reason"))
    return p.select("p_partkey", F.array_join(P.axes_claimed("reason"), ",").alias("axes"), P.claim_specificity("reason", S.strings(["modality"]), k % 5 > 0).alias("specificity"))


@query("""select p_partkey, case when p_partkey % 3 = 0 or p_partkey % 3 = 1 then 'format' else 'rule' end as class from part""")
def forfeit_class(spark, d):
    k = F.col("p_partkey")
    e = F.when(k % 3 == 0, F.concat(F.lit("missing block "), "p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" needs a payload"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", P.error_class(e, ["missing block"], ["needs a payload"], ["empty"]).alias("class"))


@query("""select o_orderkey, cast(cast('0x' || substr(sha1(cast(o_orderkey as varchar)), 1, 16) as ubigint) as varchar) as seed from orders""")
def hash_seed(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.hash64(F.col("o_orderkey").cast("string")).cast("string").alias("seed"))


@query("""with t as (select conv_id, turn, role, case role when 'assistant' then 0.1 when 'system' then 0.0 else -0.05 end + case when length(text) > 200 then 0.2 else 0.0 end as reward, length(text) as size from conversations)
select conv_id, count(*) as turns, count(*) filter (where size < 100) as fallbacks, count(*) filter (where reward < 0) as invalid_turns, round(sum(reward), 4) as reward_sum, count(*) filter (where role = 'assistant') as workup_turns from t group by 1""")
def episode_metrics(spark, d):
    t = turns(spark, d).select("conv_id", F.col("role").alias("verb"), F.when(F.col("role") == "assistant", "workup").otherwise("history").alias("phase"), (F.col("size") < 100).alias("fallback"), "reward", F.lit(None).cast("array<string>").alias("released"))
    return X.episode_metrics(t, ["conv_id"]).select("conv_id", "turns", "fallbacks", "invalid_turns", "reward_sum", "workup_turns")


@query("""select conv_id % 20 as grp, role as anchor, count(*) as n from conversations where turn > 0 group by 1, 2 having count(*) >= 2""")
def anchor_collisions(spark, d):
    return X.anchor_collisions(table(spark, d, "conversations").select((F.col("conv_id") % 20).alias("grp"), F.col("role").alias("anchor"), "turn"), "grp", "anchor", "turn")


@query("""select c_custkey from customer where c_nationkey % 4 + 1 <= 3 and c_acctbal > 0 and c_custkey % 7 <> 0 and c_custkey % 11 < 8""")
def admitted_tasks(spark, d):
    k = F.col("c_custkey")
    state = table(spark, d, "customer").select(k, (F.col("c_nationkey") % 4 + 1).alias("horizon"), (F.col("c_acctbal") <= 0).alias("retired"), (k % 7 == 0).alias("shelved"), (k % 11).alias("visits"))
    return U.admitted(state, 3, 8).select("c_custkey")


@query("""with i as (select p_partkey, [p_brand, p_type, p_brand, p_name, 'used'] as items from part) select p_partkey, array_to_string(list_filter([p_brand, p_type, p_name], lambda x: x <> 'used')[1:2], ';') as items from (select p.p_partkey, p_brand, p_type, p_name from part p)""")
def lenient_items(spark, d):
    items = F.array("p_brand", "p_type", "p_brand", "p_name", F.lit("used"))
    return table(spark, d, "part").select("p_partkey", F.array_join(P.lenient_items(items, S.strings(["used"]), 2), ";").alias("items"))


@query("""with u as (select distinct user_id from events), need as (select user_id, cast(unnest(range(30)) as int) as k from u) select user_id, k from need except select user_id, cast(day(ts) as int) from events""")
def missing_chunks(spark, d):
    events = table(spark, d, "events")
    need = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    return need.exceptAll(events.select("user_id", F.dayofmonth("ts").alias("k")).distinct())


@query("""select o_orderkey, o_totalprice from orders order by o_orderkey limit 100 offset 50""")
def file_page(spark, d):
    return X.page_of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50, 100)


@query("""select p_partkey, 'Is ' || p_name || ' the same as ' || p_type || '?' as prompt from part""")
def filled_template(spark, d):
    return table(spark, d, "part").select("p_partkey", S.fill("Is {gold} the same as {given}?", gold=F.col("p_name"), given=F.col("p_type")).alias("prompt"))


@query()
def label_ladder(spark, d):
    p = table(spark, d, "part")
    cid = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    raw = p.select(F.lit("part").alias("src"), cid.alias("cid"), F.col("p_name").alias("name"), F.lit("pref").alias("kind"), F.lit(0).alias("ord"))
    tables = O.build(raw, spark.createDataFrame([], "src string, child string, parent string"))
    return O.resolve_by_label(p.select(F.upper("p_name").alias("term")), tables)


_ACTIONS = """a as (select event_id, event_id as k, ['ask', 'begin_workup', 'physical_examination', 'order_tests', 'consult_specialist', 'search', 'final_diagnosis', 'defer_to_human'][event_id % 8 + 1] as verb,
  ['', 'Fabry disease', 'a | b', '[reason]', 'unknown', 'cardiology', 'Radiology '][event_id % 7 + 1] as payload, event_id % 5 < 2 as history, event_id % 11 as asks, event_id % 3 as workup, event_id % 4 as searches, event_id % 13 = 0 as must_end,
  event_id % 17 >= 8 as repeats, case when event_id % 2 = 0 then ['exam:skin', 'test:lab/urine'] else [] end as used,
  case event_id % 9 when 1 then ['Skin'] when 2 then ['Lab/Blood', 'Skin'] when 3 then ['Lab/Blood', 'Lab/Urine', 'Physical Examination/Heart', 'Lab/Blood'] when 4 then ['heart'] when 5 then ['Physical Examination/Skin'] when 6 then ['Lab/Urine'] when 7 then ['Bogus'] else [] end as items from events),
b as (select *, verb in ('physical_examination', 'order_tests') as listed, lower(trim(payload)) as dept,
  len(list_filter(items, lambda x: not list_contains(case when verb = 'physical_examination' then ['skin', 'heart'] else ['lab/blood', 'lab/urine', 'physical examination/skin', 'physical examination/heart'] end, lower(x)))) > 0 as odd,
  len(list_filter(items, lambda x: list_contains(used, case when verb = 'physical_examination' then 'exam:' || lower(x) when lower(x) like 'physical examination/%' then 'exam:' || lower(x)[22:] else 'test:' || lower(x) end))) > 0 as again from a)"""


@query(f"""with {_ACTIONS} select event_id, case when listed and k % 19 = 0 then 'unknown_category' when verb = 'defer_to_human' and history then 'defer_in_history' when verb = 'final_diagnosis' and history then 'final_in_history'
  when verb = 'defer_to_human' and payload = '[reason]' then 'defer_slot_echoed' when verb = 'final_diagnosis' and payload = 'a | b' then 'several_diagnoses' when verb = 'final_diagnosis' and payload = '[reason]' then 'brackets'
  when verb = 'final_diagnosis' and not must_end and workup < 1 then 'workup_too_short' when must_end and verb not in ('final_diagnosis', 'defer_to_human') then 'must_end'
  when verb = 'ask' and not history then 'interview_over' when verb = 'ask' and asks >= 9 then 'no_questions_left' when verb = 'ask' and payload = '[reason]' then 'ask_slot_echoed' when verb = 'ask' and repeats then 'question_repeated'
  when history and verb not in ('ask', 'defer_to_human') and asks < 2 then 'history_too_thin' when verb = 'final_diagnosis' and payload = 'unknown' then 'no_diagnosis' when verb = 'begin_workup' and not history then 'workup_begun'
  when listed and len(items) = 0 then 'no_items' when listed and odd then 'unknown_items' when listed and len(items) > 3 then 'too_many_items' when listed and again then 'items_repeated'
  when verb = 'consult_specialist' and dept not in ('cardiology', 'radiology') then 'unknown_department' when verb = 'consult_specialist' and not (k % 3 = 0 and dept = 'cardiology') then 'nothing_pending'
  when verb = 'search' and searches >= 3 then 'no_searches_left' when verb = 'search' and k % 2 = 1 and payload = 'Fabry disease' then 'search_repeated' end as fault from b""")
def action_checks(spark, d):
    from ..operators import admissible as A

    k = F.col("event_id")
    nth = lambda values, n: F.element_at(S.strings(values), (k % n + 1).cast("int"))
    items = F.when(k % 9 == 1, S.strings(["Skin"])).when(k % 9 == 2, S.strings(["Lab/Blood", "Skin"])).when(k % 9 == 3, S.strings(["Lab/Blood", "Lab/Urine", "Physical Examination/Heart", "Lab/Blood"]))
    items = items.when(k % 9 == 4, S.strings(["heart"])).when(k % 9 == 5, S.strings(["Physical Examination/Skin"])).when(k % 9 == 6, S.strings(["Lab/Urine"])).when(k % 9 == 7, S.strings(["Bogus"])).when(k % 9 == 8, S.strings([]))
    actions = table(spark, d, "events").select(
        k, nth([A.ASK, A.BEGIN, A.EXAMINE, A.ORDER, A.CONSULT, A.SEARCH, A.FINAL, A.DEFER], 8).alias("verb"), nth(["", "Fabry disease", "a | b", "[reason]", "unknown", "cardiology", "Radiology "], 7).alias("payload"),
        F.when(k % 5 < 2, "history").otherwise("workup").alias("phase"), (k % 11).alias("asks_used"), (k % 3).alias("workup_used"), (k % 4).alias("searches_used"), (k % 13 == 0).alias("must_end"), ((k % 17) / 16).alias("overlap"),
        F.when(k % 2 == 0, S.strings(["exam:skin", "test:lab/urine"])).alias("used"), items.alias("items"), F.when(k % 19 == 0, S.strings(["x"])).alias("dropped"), F.when(k % 3 == 0, S.strings(["cardiology"])).alias("pending"),
        F.when(k % 2 == 1, S.strings(["fabry disease"])).alias("searched"),
    )
    rules = A.Rules(max_asks=9, min_asks=2, examinations=("Skin", "Heart"), tests=("Lab/Blood", "Lab/Urine"), departments=("cardiology", "radiology"), slot_phrases=("your reason",))
    return A.checked(actions, rules).select("event_id", "fault")


@query("""with r as (select l_orderkey, case when l_linenumber % 5 <> 0 then round(l_quantity / 50, 2) end as score, case when l_linenumber % 5 <> 0 then case when l_returnflag = 'R' then greatest(round(l_quantity / 50, 2), 0.9) else round(l_quantity / 50, 2) end end as lifted, l_tax, l_linestatus from lineitem),
g as (select l_orderkey, count(score) as n, median(score) as prefusion, median(lifted) as up, bool_or(l_tax > 0.07) as veto, max(l_tax) as fallback from r group by 1), f as (select *, case when n < 3 or prefusion >= 0.85 then prefusion else up end as fused from g)
select l_orderkey, round(prefusion, 6) as prefusion, round(fused, 6) as fused, case when n < 3 then fallback when fused >= 0.85 and veto then 0.5 when fused >= 0.85 then 1.0 else 0.0 end as dx_score, case when n < 3 then 'ontology_fallback' else 'panel' end as source, n >= 3 as cached from f""")
def verdict_service(spark, d):
    from ..operators.judging import verdict_ladder

    score = F.when(F.col("l_linenumber") % 5 != 0, F.round(F.col("l_quantity") / 50, 2))
    rows = table(spark, d, "lineitem").select("l_orderkey", score.alias("s"), F.when(F.col("l_returnflag") == "R", F.greatest(score, F.lit(0.9))).otherwise(score).alias("u"), "l_tax")
    # greatest skips nulls, so an unread reply is lifted from nothing only after the panel's size is known
    cases = rows.groupBy("l_orderkey").agg(F.collect_list("s").alias("scores"), F.collect_list(F.when(F.col("s").isNotNull(), F.col("u"))).alias("lifted"), F.bool_or(F.col("l_tax") > 0.07).alias("veto"), F.max("l_tax").alias("fallback"))
    return verdict_ladder(cases).select("l_orderkey", F.round("prefusion", 6).alias("prefusion"), F.round("fused", 6).alias("fused"), "dx_score", "source", "cached")


@query("""with m as (select user_id, round(avg(value), 2) as recall, count(*) as asks from events group by 1), n as (select *, case when exists (select 1 from events e where e.user_id = m.user_id and event_type = 'purchase') then 'bought' else 'left' end as outcome from m)
select 'episodes' as part, 'all' as name, cast(count(*) as double) as value from n union all select 'outcome', outcome, count(*) from n group by 2 union all select 'mean', 'recall', round(avg(recall), 4) from n union all select 'mean', 'asks', round(avg(asks), 2) from n
union all select 'sum', 'asks', sum(asks) from n union all select 'count', 'many', count(*) filter (where asks > 65) from n union all select 'verb', event_type, count(*) from events group by 2""")
def episode_report(spark, d):
    from ..operators.taxonomy import episode_report as report

    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    records = each.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("actions_by_verb"), F.round(F.sum("v") / F.sum("n"), 2).alias("recall"), F.sum("n").alias("asks"), F.when(F.bool_or(F.col("event_type") == "purchase"), "bought").otherwise("left").alias("outcome")
    )
    return report(records, {"recall": 4, "asks": 2}, ["asks"], {"many": F.col("asks") > 65})


@query("""select c_custkey, regexp_replace(c_name || '/' || c_mktsegment || ' é', '[^A-Za-z0-9_-]', '_', 'g')[1:64] as custom_id from customer""")
def custom_ids(spark, d):
    from ..operators.joins import custom_id

    return table(spark, d, "customer").select("c_custkey", custom_id(F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit(" é"))).alias("custom_id"))

"""Joins, outcomes, prices, graders, ontology, taxonomy and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as M
from ..functions import text as S
from ..operators import joins as J
from ..operators import judging as G
from ..operators import ontology as O
from ..operators import outcomes as P
from ..operators import taxonomy as X
from .credit import _DAY, day
from .registry import query, table

BOUNDS = J.phase_bounds([0.3, 0.3, 0.4], 5, 30)


@query(f"""select event_id, {_DAY} as step, case when {_DAY} < {BOUNDS[0][1]} then 0 when {_DAY} < {BOUNDS[1][1]} then 1 else 2 end as phase from events""")
def phase_range_join(spark, d):
    return J.by_phase(table(spark, d, "events").select("event_id", day().alias("step")), F.col("step"), spark, BOUNDS).select("event_id", "step", "phase")


@query(f"""select event_id, case when {_DAY} < 10 then 0 when {_DAY} < 20 then 1 else 2 end as generation from events""")
def lineage_asof_join(spark, d):
    return J.as_of(table(spark, d, "events").select("event_id", day().alias("step")), F.col("step"), spark, [(0, 0), (10, 1), (20, 2)]).select("event_id", "generation")


@query("""with v as (select user_id, epoch_us(ts) * 1000 + event_id % 1000 as t, value from events where event_type = 'view'), c as (select event_id, user_id, epoch_us(ts) * 1000 + event_id % 1000 as t from events where event_type = 'purchase')
select c.event_id, v.value as view_value from c asof left join v on c.user_id = v.user_id and c.t >= v.t""")
def asof_last_view(spark, d):
    e = table(spark, d, "events").withColumn("t", F.struct("ts", "event_id"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", F.col("t").alias("since"), F.col("value").alias("view_value"))
    return J.as_of_join(left, right, ["user_id"], "t", "since", ["view_value"]).select("event_id", "view_value")


@query("""select c_custkey, cast(r as int) as rollout from customer, range(3) t(r) where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 3 = r)""")
def resume_anti_join(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3).cast("int").alias("rollout")).distinct()
    return J.pending(table(spark, d, "customer").select("c_custkey"), 3, done, ["c_custkey", "rollout"])


@query("""select doc_id, quality, toxic, quality is not null as matched from documents left join labels using (doc_id)""")
def gold_left_join(spark, d):
    return J.left_by_key(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic", "matched")


@query("""select count(*) as shared from (select doc_id from labels where quality = 1 intersect select doc_id from labels where quality = 0)""")
def disjoint_check(spark, d):
    labels = table(spark, d, "labels")
    return labels.where("quality = 1").select("doc_id").intersect(labels.where("quality = 0").select("doc_id")).agg(F.count("*").alias("shared"))


@query("""select o_custkey, list_sort(list(distinct o_orderstatus)) as scorers from orders group by 1 having count(distinct o_orderstatus) > 1""")
def uniform_scorer_check(spark, d):
    return J.mixed_groups(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


CHAPTERS = [(65 * 100, 66 * 100 + 99, 1, "A-B"), (67 * 100, 68 * 100 + 48, 2, "C-D48"), (68 * 100 + 50, 68 * 100 + 89, 3, "D50-D89"), (83 * 100, 84 * 100 + 98, 4, "S-T98")]


@query("""with c as (select p_partkey, chr(cast(65 + p_partkey % 20 as int)) || lpad(cast(p_size as varchar), 2, '0') as code from part)
select p_partkey, code, case when ascii(code) * 100 + cast(substr(code, 2, 2) as int) between 6500 and 6699 then 'A-B' when ascii(code) * 100 + cast(substr(code, 2, 2) as int) between 6700 and 6848 then 'C-D48'
  when ascii(code) * 100 + cast(substr(code, 2, 2) as int) between 6850 and 6889 then 'D50-D89' when ascii(code) * 100 + cast(substr(code, 2, 2) as int) between 8300 and 8498 then 'S-T98' end as chapter from c""")
def chapter_range(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.char(F.lit(65) + F.col("p_partkey") % 20), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("code"))
    return J.chapter_of(p, "code", spark.createDataFrame(CHAPTERS, "lo int, hi int, ord int, chapter string"))


@query("""with a as (select distinct p_brand as k, 'B:' || p_brand as code from part where p_size < 10), b as (select distinct p_type as k, 'T:' || p_type as code from part where p_size > 45)
select p_partkey, coalesce(a.code, b.code) as code, case when a.code is not null then 'brand' when b.code is not null then 'type' end as method
from part left join a on p_brand || '' = a.k and p_partkey % 2 = 0 left join b on p_type = b.k""")
def code_ladder(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size < 10").select(F.col("p_brand").alias("k"), F.concat(F.lit("B:"), "p_brand").alias("code")).distinct()
    b = p.where("p_size > 45").select(F.col("p_type").alias("k"), F.concat(F.lit("T:"), "p_type").alias("code")).distinct()
    one = J.by_ladder(p.select("p_partkey", "p_type", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("b")), F.col("b"), [(a, "k", "brand")]).withColumnsRenamed({"code": "c1", "method": "m1"})
    two = J.by_ladder(one, F.col("p_type"), [(b, "k", "type")])
    return two.select("p_partkey", F.coalesce("c1", "code").alias("code"), F.coalesce("m1", "method").alias("method"))


@query("""with v as (select n_nationkey as victim_id, r_name as category from nation join region on n_regionkey = r_regionkey) select count(*) as victims, count(*) as swapped from v""")
def swap_pool(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed-size tables
    pairs = J.swap_candidates(n.select(F.col("n_nationkey").alias("victim_id"), F.col("r_name").alias("category")), n.select(F.col("n_name").alias("donor_id"), F.col("r_name").alias("category")), "seed")
    return pairs.agg(F.count("*").alias("victims"), F.count_if(F.col("donor_id").isNotNull() & (F.col("donor_category") != F.col("category"))).alias("swapped"))


# outcomes and prices

_ENDS = """e as (select o_orderkey, o_orderstatus, o_totalprice, count(*) as n, count(*) filter (where l_returnflag = 'R') as bad, count(*) filter (where l_linestatus = 'F') as read, max(l_discount) as md
  from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3),
k as (select *, case o_orderstatus when 'F' then 'dx' when 'O' then case when o_orderkey % 3 = 0 then 'defer_mismatch' when o_orderkey % 3 = 1 then 'defer_ook' else 'defer_mismatch_claimed' end else 'format_failure' end as kind,
  case when o_orderkey % 2 = 0 then 'exact' when o_orderkey % 5 = 0 then 'partial' end as subkind, case when n > 3 then least(1.0, read / n) else 1.0 end as coverage, cast(o_orderkey % 4 as int) as workup,
  least(1.0, greatest(0.0, md * 10)) as score, bad > 2 as armed, o_orderkey % 7 = 0 as bound from e)"""


def _endings(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    e = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.count_if(F.col("l_linestatus") == "F").alias("read"), F.max("l_discount").alias("md"))
    e = o.join(e, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    open_ = F.when(k % 3 == 0, "defer_mismatch").when(k % 3 == 1, "defer_ook").otherwise("defer_mismatch_claimed")
    none = S.strings([])
    return e.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "dx").when(F.col("o_orderstatus") == "O", open_).otherwise("format_failure").alias("kind"), F.when(k % 2 == 0, "exact").when(k % 5 == 0, "partial").alias("subkind"),
        P.evidence_coverage(F.col("read"), F.when(F.col("n") > 3, F.col("n")), none, none).alias("coverage"), (k % 4).cast("int").alias("workup"), M.clamp(F.col("md") * 10, 0.0, 1.0).alias("score"),
        (F.col("bad") > 2).alias("armed"), (k % 7 == 0).alias("bound"),
    )


@query(f"""with {_ENDS} select o_orderkey, round(coverage, 6) as coverage from k""")
def evidence_coverage(spark, d):
    return _endings(spark, d).select("o_orderkey", F.round("coverage", 6).alias("coverage"))


_PRICE = """case kind when 'dx' then case when score = 0 and workup = 0 then -0.05 when armed and not bound then least(score * (0.1 + 0.9 * sqrt(coverage)), 0.4) else score * (0.1 + 0.9 * sqrt(coverage)) end
  when 'format_failure' then -0.1 when 'defer_mismatch' then case subkind when 'exact' then 0.9 when 'partial' then 0.65 else -0.1 end
  when 'defer_mismatch_claimed' then case when not bound then -0.1 when subkind = 'exact' then 0.9 else 0.65 end else case when o_orderkey % 2 = 0 then 0.4 else -0.05 end end"""


def _facts(e):
    f = F.lit(False)
    return {
        "kind": F.col("kind"), "subkind": F.col("subkind"), "score": F.col("score"), "workup_turns": F.col("workup"), "channel": F.lit(None), "exposed": f, "passed": f, "coverage": F.col("coverage"), "armed": F.col("armed"),
        "bound": F.col("bound"), "expected": F.lit(0), "task_kind": F.when(F.col("o_orderkey") % 2 == 0, "ook").otherwise("answer"), "specificity": F.col("subkind"),
    }


@query(f"""with {_ENDS} select o_orderkey, kind, round({_PRICE}, 6) as price from k""")
def price_board(spark, d):
    e = _endings(spark, d)
    return e.select("o_orderkey", "kind", F.round(P.terminal_price(_facts(e)), 6).alias("price"))


@query(f"""with {_ENDS} select o_orderkey, case when kind <> 'dx' then 'not_dx' when score = 0 and workup = 0 then 'zero_workup' when armed and not bound then 'blind_cap' when score <= 0 then 'wrong' else 'full' end as branch from k""")
def credit_branch(spark, d):
    e = _endings(spark, d)
    return e.select("o_orderkey", P.credit_branch(_facts(e)).alias("branch"))


@query(f"""with {_ENDS}, p as (select o_orderkey, kind, score, {_PRICE} as price from k) select o_orderkey,
  case when kind = 'dx' then score >= 1.0 when kind in ('defer_mismatch', 'defer_mismatch_claimed') then price > 0 else kind = 'defer_ook' and o_orderkey % 2 = 0 end as won_session,
  case when kind in ('dx', 'defer_mismatch', 'defer_mismatch_claimed') then price > 0 else kind = 'defer_ook' and o_orderkey % 2 = 0 end as won_trainer from p""")
def success_flags(spark, d):
    e = _endings(spark, d)
    facts = _facts(e)
    p = e.withColumn("price", P.terminal_price(facts)).withColumn("task_kind", facts["task_kind"])
    return p.select("o_orderkey", P.won_session(F.col("kind"), F.col("score"), F.col("price"), F.col("task_kind")).alias("won_session"), P.won_trainer(F.col("kind"), F.col("price"), F.col("task_kind")).alias("won_trainer"))


@query(f"""with {_ENDS}, p as (select {_PRICE} as price, case when o_orderkey % 11 = 0 then {_PRICE} + 0.5 else {_PRICE} end as stored from k) select count(*) as n, count(*) filter (where abs(price - stored) > 1e-9) as mismatched from p""")
def replay_gate(spark, d):
    e = _endings(spark, d)
    p = e.withColumn("price", P.terminal_price(_facts(e))).withColumn("stored", F.when(F.col("o_orderkey") % 11 == 0, F.col("price") + 0.5).otherwise(F.col("price")))
    return p.agg(*P.mismatch_counts("price", "stored"))


@query("""with l as (select conv_id, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by 1)
select conv_id, case when role = 'assistant' and conv_id % 9 = 0 then 'format_failure' when role = 'assistant' and conv_id % 7 = 0 then 'defer_ook' when role = 'assistant' then 'dx' when conv_id % 2 = 0 then 'defer_mismatch'
  when conv_id % 5 = 0 then 'defer_mismatch_claimed' else 'defer_ook' end as kind,
  case when role <> 'assistant' and conv_id % 2 = 0 then case when conv_id % 3 = 0 then null when conv_id % 4 = 0 then 'exact' else 'partial' end end as subkind from l""")
def outcome_class(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))
    k, dx = F.col("conv_id"), F.col("role") == "assistant"
    final = F.struct(
        F.when(dx, "final_diagnosis").otherwise("defer").alias("kind"), F.when(k % 9 == 0, "synthesized").otherwise("model").alias("source"), F.when(k % 7 == 0, F.lit("Unknown | x")).otherwise(F.concat(F.lit("Case "), "text")).alias("diagnosis"),
        (~dx & (k % 2 == 0)).alias("gate"), F.when(k % 5 == 0, "Mismatch - wrong test").otherwise("out of knowledge").alias("reason"),
    )
    turns = F.array(F.struct(F.struct(F.lit("mismatch").alias("verdict"), (k % 3 != 0).alias("gt_mismatch"), F.when(k % 4 == 0, S.strings(["modality"])).otherwise(S.strings([])).alias("axes"), S.strings(["modality", "anatomy"]).alias("gt_axes")).alias("gate")))
    found = last.withColumn("final", final).withColumn("turns", turns)
    return found.select("conv_id", P.outcome(F.col("final"), P.last_gate(F.col("turns"))).alias("o")).select("conv_id", "o.kind", "o.subkind")


@query("""select l_orderkey, l_linenumber, case when l_returnflag <> 'R' then case when l_linestatus = 'F' then 1.0 else -0.5 end when l_linestatus = 'F' then -2.0 when l_quantity > 25 then 1.25 else 0.75 end as payoff from lineitem""")
def gate_reward(spark, d):
    li = table(spark, d, "lineitem")
    axes = F.when(F.col("l_quantity") > 25, S.strings(["modality"])).otherwise(S.strings([]))
    return li.select("l_orderkey", "l_linenumber", P.gate_reward(F.col("l_returnflag") == "R", S.strings(["modality", "anatomy"]), F.when(F.col("l_linestatus") == "F", "pass").otherwise("mismatch"), axes).alias("payoff"))


# graders

_COUNTS = "c as (select o_orderkey, cast(o_orderkey % 4 as int) as gt, cast(o_custkey % 5 as int) as pred from orders), m as (select *, least(gt, pred) as t from c), l as (select *, (t + 2) // 3 as f, (t + 1) // 3 as co, t // 3 as pa from m), s as (select *, f + 0.85 * co + 0.5 * pa as tp from l)"


def _counts(spark, d):
    c = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("gt"), (F.col("o_custkey") % 5).cast("int").alias("pred")).withColumn("t", F.least("gt", "pred"))
    return c.select("o_orderkey", "gt", "pred", F.expr("(t + 2) div 3").cast("int").alias("f"), F.expr("(t + 1) div 3").cast("int").alias("co"), F.expr("t div 3").cast("int").alias("pa"))


def _oracle_ratio(a, b):
    return f"round(coalesce(({a}) / nullif({b}, 0), 1.0), 6)"


@query(f"""with {_COUNTS} select o_orderkey, round(tp, 6) as soft_tp, {_oracle_ratio('tp', 'tp + 0.3 * greatest(0.0, pred - tp) + 0.7 * greatest(0.0, gt - tp)')} as t_reward, {_oracle_ratio('tp', 'tp + 0.5 * greatest(0.0, pred - tp) + 0.5 * greatest(0.0, gt - tp)')} as tversky_balanced,
  {_oracle_ratio('tp', 'tp + 0.7 * greatest(0.0, pred - tp) + 0.3 * greatest(0.0, gt - tp)')} as tversky_fp_heavy, {_oracle_ratio('tp', 'tp + greatest(0.0, pred - tp) + greatest(0.0, gt - tp)')} as jaccard_weighted,
  {_oracle_ratio('cast(t as double)', 'gt + pred - t')} as jaccard_count, {_oracle_ratio('2 * tp', '2 * tp + greatest(0.0, pred - tp) + greatest(0.0, gt - tp)')} as dice, {_oracle_ratio('tp', 'greatest(gt, pred)')} as acc,
  case when f = gt and gt = pred then 1.0 else 0.0 end as acc_exact, case when f = gt then 1.0 else 0.0 end as acc_strict, case when f + co = gt then 1.0 else 0.0 end as acc_lenient from s""")
def tversky_scores(spark, d):
    c = _counts(spark, d)
    return c.select("o_orderkey", *[F.round(v, 6).alias(k) for k, v in G.level_scores(F.col("gt"), F.col("pred"), F.col("f"), F.col("co"), F.col("pa")).items()])


@query("""with v as (select o_custkey as case_id, o_totalprice / 1000 as score, case when o_orderkey % 3 > 0 then 1 else 0 end as vote from orders)
select case_id, count(*) as graders, round(avg(score), 2) as score, cast(sum(vote) >= ceil(count(*) / 2.0) as int) as vote from v group by 1""")
def majority_vote(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderkey") % 3 > 0).cast("int").alias("vote"))
    return G.panel(o, "case_id", ["score"], ["vote"]).withColumn("score", F.round("score", 2))


_T = "({tp}) / nullif({tp} + 0.3 * greatest(0.0, {p} - ({tp})) + 0.7 * greatest(0.0, {g} - ({tp})), 0)"


@query(f"""with d as (select o_custkey as case_id, o_orderkey, cast(1 + o_orderkey % 2 as int) as gt, cast(1 + o_orderkey % 3 as int) as pred, case when o_orderkey % 4 = 0 then 0 else 1 end as has, case o_orderkey % 5 when 0 then 'full' when 1 then 'core' else 'partial' end as lv,
  case when o_custkey % 3 = 0 then 'full' when o_custkey % 3 = 1 then 'core' end as fl from orders),
u as (select *, case when has = 1 then case when lv = 'full' then 1.0 when lv = 'core' then 0.85 else 0.5 end else 0.0 end as tp0,
  case when has = 0 and fl is null then 0.0 when has = 0 then case fl when 'full' then 1.0 else 0.85 end
    else greatest(case when lv = 'full' then 1.0 when lv = 'core' then 0.85 else 0.5 end, case fl when 'full' then 1.0 when 'core' then 0.85 else 0.0 end) end as tp1 from d)
select case_id, round(median(coalesce({_T.format(tp='tp0', p='pred', g='gt')}, 1.0)), 6) as median_pre, round(median(coalesce({_T.format(tp='tp1', p='pred', g='gt')}, 1.0)), 6) as median_post from u group by 1""")
def median_fusion(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    level = F.when(k % 5 == 0, "full").when(k % 5 == 1, "core").otherwise("partial")
    verdict = F.when(F.col("o_custkey") % 3 == 0, "FULL").when(F.col("o_custkey") % 3 == 1, "CORE").otherwise("NONE")
    rows = o.select(
        F.col("o_custkey").alias("case_id"), k.alias("grader"), (1 + k % 2).cast("int").alias("gt"), (1 + k % 3).cast("int").alias("pred"), F.when(k % 4 == 0, S.strings([])).otherwise(F.array(level)).alias("levels"), verdict.alias("verdict"),
        F.lit("high").alias("confidence"), F.lit(False).alias("blank"),
    )
    return G.fuse(rows).select("case_id", F.round("median_pre", 6).alias("median_pre"), F.round("median_post", 6).alias("median_post"))


@query("""with m as (select count(*) as n, avg(case when quality = toxic then 1.0 else 0.0 end) as a, avg(quality) as p, avg(toxic) as q, covar_pop(quality, toxic) as c, stddev_pop(quality) as x, stddev_pop(toxic) as y from labels)
select n, round(a, 6) as agreement, round((a - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 6) as kappa, round(c / (x * y), 6) as pearson from m""")
def judge_agreement(spark, d):
    agree = F.avg((F.col("quality") == F.col("toxic")).cast("double"))
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(agree, 6).alias("agreement"), F.round(M.kappa("quality", "toxic"), 6).alias("kappa"), F.round(M.pearson("quality", "toxic"), 6).alias("pearson"))


@query("""with b as (select doc_id, n_chars % 101 / 100.0 as m, case when quality = 1 then 'FULL' when toxic = 1 then 'NONE' else 'CORE' end as v from labels join documents using (doc_id)), w as (select *, case v when 'FULL' then 1.0 when 'NONE' then 0.0 else 0.85 end as w from b)
select cast(doc_id as varchar) as case_id, round(abs(m - w), 6) as gap, case when (w >= 0.85 and m < 0.5) or (w = 0 and m >= 0.85) then 'hard' else 'soft' end as kind from w where abs(m - w) >= 0.35""")
def disagreement_board(spark, d):
    b = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    v = F.when(F.col("quality") == 1, "FULL").when(F.col("toxic") == 1, "NONE").otherwise("CORE")
    rows = b.select(F.col("doc_id").cast("string").alias("case_id"), (F.col("n_chars") % 101 / 100.0).alias("m"), v.alias("v"))
    weight = F.create_map(*[F.lit(x) for kv in G.WEIGHT.items() for x in kv])
    return G.board(rows.select("case_id", F.abs(F.col("m") - weight[F.col("v")]).alias("gap"), G.disagreement(F.col("m"), F.col("v")).alias("kind"))).withColumn("gap", F.round("gap", 6))


@query("""with g as (select distinct l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem), k as (select l_orderkey, l_linenumber, min(l_returnflag) as v from g group by 1, 2)
select a.l_linenumber as a, b.l_linenumber as b, count(*) as n, count(*) filter (where a.v = b.v) as agreed from k a join k b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber group by 1, 2""")
def grader_pairs(spark, d):
    graded = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("v"))
    return G.pairs_of(graded, "l_orderkey", "l_linenumber", "v").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("a_value") == F.col("b_value")).alias("agreed"))


@query("""select case when length(lower(p_brand)) + length(lower(p_type)) > 28 then 'FULL' else 'NONE' end as verdict, count(*) as n from part group by 1""")
def verdict_histogram(spark, d):
    judge = lambda k: k.withColumn("verdict", F.when(F.length("_p") + F.length("_g") > 28, "FULL").otherwise("NONE"))
    return G.deduped_verdicts(table(spark, d, "part").select(F.col("p_brand").alias("pred"), F.col("p_type").alias("gold")), judge).groupBy("verdict").agg(F.count("*").alias("n"))


# ontology

_EDGES = "e as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union select 'c' || c_custkey, 'n' || c_nationkey from customer union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'r' || r_regionkey, 'world' from region)"


def _edges(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pair = lambda t, a, b: table(spark, d, t).select(a.alias("child"), b.alias("parent"))
    return (
        pair("nation", name("n", "n_nationkey"), name("r", "n_regionkey")).union(pair("customer", name("c", "c_custkey"), name("n", "c_nationkey")))
        .union(pair("supplier", name("s", "s_suppkey"), name("n", "s_nationkey"))).union(pair("region", name("r", "r_regionkey"), F.lit("world"))).distinct()
    )


@query(f"""with recursive {_EDGES}, w as (select child as cid, parent as ancestor, 1 as depth from e where child like 'c%' union all select w.cid, e.parent, w.depth + 1 from w join e on w.ancestor = e.child where w.depth < 4)
select cid, ancestor, cast(min(depth) as int) as depth from w group by 1, 2""")
def bounded_ancestors(spark, d):
    e = _edges(spark, d)
    return O.ancestors(e.where("child like 'c%'").select(F.col("child").alias("cid")), e)


@query(f"""with {_EDGES}, n as (select child, parent from e where child like 's%'), p as (select 's' || s_suppkey as a, case when s_suppkey % 4 = 0 then 'n' || s_nationkey when s_suppkey % 4 = 1 then 's' || (s_suppkey - 1) when s_suppkey % 4 = 2 then 's' || s_suppkey else 'c1' end as b from supplier),
x as (select a, b, pa.parent as na, pb.parent as nb, ra.parent as ra, rb.parent as rb from p left join e pa on a = pa.child left join e pb on b = pb.child left join e ra on pa.parent = ra.child left join e rb on pb.parent = rb.child)
select a, b, case when a = b then 'equivalent' when na = b or ra = b then 'a_subtype_of_b' when na = nb then 'siblings' when na is null or nb is null then 'unrelated' else 'distant' end as relation,
  cast(case when a = b then null when na = b then 1 when ra = b then 2 end as int) as depth,
  cast(case when a <> b and na <> b and ra <> b and na <> nb then case when ra = rb then 2 else 3 end end as int) as depth_a, cast(case when a <> b and na <> b and ra <> b and na <> nb then case when ra = rb then 2 else 3 end end as int) as depth_b from x""")
def pair_relation(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    b = F.when(k % 4 == 0, name("n", F.col("s_nationkey"))).when(k % 4 == 1, name("s", k - 1)).when(k % 4 == 2, name("s", k)).otherwise("c1")
    return O.relations(s.select(name("s", k).alias("a"), b.alias("b")), _edges(spark, d))


_TOK = "t as (select distinct 'p' || p_partkey as cid, tok from (select p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as raw from part), lateral (select case when raw like '%s' and raw not like '%ss' and length(raw) > 3 then raw[1:length(raw) - 1] else raw end as tok) x)"


def _part_tables(spark, d):
    p = table(spark, d, "part")
    cid = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return p.select(cid.alias("cid"), F.explode(S.name_tokens("p_name")).alias("tok")).distinct(), p.select(cid.alias("cid"), F.col("p_name").alias("label"))


def _part_terms(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()


_Q = "q as (select distinct term, tok from (select p_name as term, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) as raw from part), lateral (select case when raw like '%s' and raw not like '%ss' and length(raw) > 3 then raw[1:length(raw) - 1] else raw end as tok) x)"


@query(f"""with {_TOK}, {_Q}, n as (select term, count(*) as need from q group by 1) select g.term, g.cid from (select term, cid, count(distinct tok) as got from q join t using (tok) group by 1, 2) g join n using (term) where got = need""")
def relational_division(spark, d):
    tokens, _ = _part_tables(spark, d)
    return O.having_all(_part_terms(spark, d), tokens)


@query(f"""with {_TOK}, {_Q}, df as (select tok, count(*) as df from t group by 1), r as (select q.term, q.tok, df <= 2 * min(df) over (partition by q.term) as rare from q join df using (tok)),
n as (select term, count(*) as n from q group by 1), nr as (select term, count(*) filter (where rare) as nr from r group by 1), g as (select r.term, t.cid, count(*) as cov, count(*) filter (where rare) as ra from r join t using (tok) group by 1, 2),
f as (select g.*, max(cov) over (partition by g.term) as top, nr from g join n using (term) join nr using (term) where cov >= (n + 1) // 2)
select term, cid from (select term, f.cid, row_number() over (partition by term order by length(p_name), f.cid) as k from f join part on 'p' || p_partkey = f.cid where cov = top and ra = nr) where k = 1""")
def rarity_fuzzy_best(spark, d):
    tokens, concepts = _part_tables(spark, d)
    return O.best_covering(_part_terms(spark, d), tokens, concepts)


@query()
def concept_ladder(spark, d):
    p = table(spark, d, "part")
    cid = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    raw = p.select(F.lit("part").alias("src"), cid.alias("cid"), F.col("p_name").alias("name"), F.lit("pref").alias("kind"), F.lit(0).alias("ord")).unionByName(
        p.select(F.lit("part").alias("src"), cid.alias("cid"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.lit("synonym").alias("kind"), F.lit(1).alias("ord"))
    )
    tables = O.build(raw, spark.createDataFrame([], "src string, child string, parent string"))
    terms = p.select(F.upper("p_name").alias("term")).union(p.select(F.concat_ws(" ", "p_name", "p_type")))
    return O.resolve(terms, tables)


@query("""with l as (select s_suppkey as k, 'x' as source, case when s_suppkey % 3 = 0 then 'equivalent' when s_suppkey % 3 = 1 then 'siblings' else 'unmapped' end as r from supplier
  union all select s_suppkey, 'y', case when s_suppkey % 5 = 0 then 'a_subtype_of_b' when s_suppkey % 5 < 3 then 'siblings' else 'unrelated' end from supplier union all select s_suppkey, 'z', case when s_suppkey % 7 = 0 then 'subtype_siblings' else 'equivalent' end from supplier),
c as (select k, count(*) filter (where r = 'a_subtype_of_b') as h, count(*) filter (where r = 'equivalent') as e, count(*) filter (where r = 'subtype_siblings') as t, count(*) filter (where r = 'siblings') as s, count(*) filter (where r <> 'unmapped') as m from l group by 1)
select k, case when h > 0 or t > 0 then 'CORE' when e > 0 then 'FULL' when s >= 2 then 'PARTIAL' when m > 0 then 'NONE' else 'UNKNOWN' end as verdict,
  case when h > 0 then case when h >= 2 or e = 0 then 'high' else 'medium' end when t > 0 then 'medium' when e > 0 then case when e >= 2 then 'high' else 'low' end when s >= 2 then 'medium' when m > 0 then case when m >= 2 then 'high' else 'low' end else 'none' end as confidence,
  case when h > 0 or t > 0 then 0.85 when e > 0 then 1.0 when s >= 2 then 0.5 when m > 0 then 0.0 end as weight from c""")
def leg_vote(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    legs = s.select(k.alias("k"), F.when(k % 3 == 0, "equivalent").when(k % 3 == 1, "siblings").otherwise("unmapped").alias("relation")).unionByName(
        s.select(k.alias("k"), F.when(k % 5 == 0, "a_subtype_of_b").when(k % 5 < 3, "siblings").otherwise("unrelated").alias("relation"))
    ).unionByName(s.select(k.alias("k"), F.when(k % 7 == 0, "subtype_siblings").otherwise("equivalent").alias("relation")))
    return O.vote(legs, ["k"])


# taxonomy

RULES = [("steel|nickel", "hard"), ("copper|brass", "soft"), ("^promo", "promo"), ("tin$", "light")]


@query("""select p_partkey, case when regexp_matches(lower(p_type), 'steel|nickel') then 'hard' when regexp_matches(lower(p_type), 'copper|brass') then 'soft' when regexp_matches(lower(p_type), '^promo') then 'promo' when regexp_matches(lower(p_type), 'tin$') then 'light' else 'other' end as material from part""")
def rule_classify(spark, d):
    return X.classified(table(spark, d, "part"), "p_type", RULES, "material", "other").select("p_partkey", "material")


@query("""select r_name, n_name, c_mktsegment, count(*) as mentions, count(distinct c_custkey) as cases, cast(1 as bigint) as concepts, 3 as level from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3
union all select r_name, n_name, null, count(*), count(distinct c_custkey), count(distinct c_mktsegment), 2 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def taxonomy_rollup(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return X.rollup(table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), "r_name", "n_name", "c_mktsegment", "c_custkey").select("r_name", "n_name", "c_mktsegment", "mentions", "cases", "concepts", "level")


@query("""with c as (select p_brand, p_type, count(*) as m, max(case when p_size < 10 then p_type end) as code from part group by 1, 2) select p_brand, count(*) as concepts, cast(sum(m) as bigint) as mentions, round(100.0 * sum(case when code is not null then m else 0 end) / sum(m), 6) as coded_pct from c group by 1""")
def coded_share(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("m"), F.max(F.when(F.col("p_size") < 10, F.col("p_type"))).alias("code"))
    return X.coded_share(c, "p_brand", "code", "m").withColumn("coded_pct", F.round("coded_pct", 6))


@query("""with b as (select l_orderkey, bool_and(l_linestatus = 'F') as a, bool_or(l_linestatus = 'F') as s, count(*) as n, count(*) filter (where l_linestatus = 'F') as f from lineitem group by 1)
select cast(sum(n) as bigint) as items, cast(sum(f) as bigint) as served, round(sum(f) / sum(n), 6) as rate, count(*) filter (where a) as cases_full, count(*) filter (where s and not a) as cases_partial from b""")
def panel_coverage(spark, d):
    return X.coverage(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F").withColumn("rate", F.round("rate", 6))


@query("""select r_name as category, count(c_custkey) as donors, count(c_custkey) >= 30 as enough from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 0 group by 1""")
def donor_census(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return X.census(c.select(F.col("r_name").alias("category")), table(spark, d, "region").select(F.col("r_name").alias("category")), "category", 30)


@query("""select event_type as verb, count(*) as n from events group by 1""")
def episode_summary(spark, d):
    by = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("actions_by_verb"))
    return X.episode_summary(by)


# text and arithmetic

_NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""select p_partkey, {_NORM.format(c="p_name || ' (' || p_type || ')'")} as normal from part""")
def normalize_text(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalize(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("normal"))


@query(f"""with n as (select p_partkey, {_NORM.format(c='p_name')} as a, {_NORM.format(c='p_type')} as b from part), s as (select *, list_distinct(string_split(a, ' ')) as x, list_distinct(string_split(b, ' ')) as y from n)
select p_partkey, case when a = '' or b = '' then 0.0 when contains(a, b) or contains(b, a) then 1.0 when len(list_filter(x, lambda w: list_contains(y, w))) / (len(x) + len(y) - len(list_filter(x, lambda w: list_contains(y, w)))) >= 0.5 then 1.0 else 0.0 end as score from s""")
def lexical_match(spark, d):
    return table(spark, d, "part").select("p_partkey", S.lexical_match("p_name", "p_type").alias("score"))


@query("""select p_partkey, trim(regexp_replace(regexp_replace('Probably ' || p_name || ', likely ' || p_type || '?', '(?i)\\b(most likely|most probable|probable|probably|likely|possible|possibly|suspected|presumed|presumptive|consistent with|rule out|r/o)\\b|\\?', ' ', 'g'), '\\s+', ' ', 'g'), ' ,;:-') as bare from part""")
def hedge_strip(spark, d):
    return table(spark, d, "part").select("p_partkey", S.strip_hedges(F.concat(F.lit("Probably "), "p_name", F.lit(", likely "), "p_type", F.lit("?"))).alias("bare"))


_STOP = ", ".join(f"'{w}'" for w in [*S.GENERIC_TOKENS, *S.LOCATION_TOKENS])


@query(f"""select p_partkey, array_to_string(list_filter(string_split({_NORM.format(c="'Chronic left ' || p_name || ' disease'")}, ' '), lambda w: not list_contains([{_STOP}], w)), ' ') as tokens from part""")
def informative_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.informative_tokens(F.concat(F.lit("Chronic left "), "p_name", F.lit(" disease"))), " ").alias("tokens"))


@query("""select a.vec_id as a, b.vec_id as b, round(greatest(0.0, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))), 5) as cosine from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id""")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("k"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.join(other, F.col("vec_id") == F.col("k")).select(F.col("vec_id").alias("a"), "b", F.round(M.cosine(F.col("embedding"), F.col("v")), 5).alias("cosine"))


@query("""select o_orderkey, sha1(cast(o_custkey as varchar) || '#' || o_orderstatus) as uid from orders""")
def content_hash_uid(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.sha1(F.concat_ws("#", F.col("o_custkey").cast("string"), "o_orderstatus")).alias("uid"))


@query("""select l_orderkey, l_linenumber, round((l_quantity * 1000 * 2.5 + l_linenumber * 100 * 10.0) / 1e6, 8) as cost from lineitem""")
def usage_cost(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.token_cost(F.col("l_quantity") * 1000, F.col("l_linenumber") * 100, F.lit(2.5), F.lit(10.0)), 8).alias("cost"))


_SHAPES = {"json_shape": r"\{[^}]*:[^}]*\}", "keyword": "(?i)score|grade", "role": "(?im)^(system|assistant):", "instruction": "(?i)ignore (all|the) "}


@query("""select doc_id, array_to_string(list_filter([case when regexp_matches(text, '\\{[^}]*:[^}]*\\}') then 'json_shape' end, case when regexp_matches(text, '(?i)score|grade') then 'rubric_keyword' end, case when regexp_matches(text, '(?im)^(system|assistant):') then 'role_marker' end,
  case when regexp_matches(text, '(?i)ignore (all|the) ') then 'instruction' end, case when length(text) > 600 then 'long' end], lambda x: x is not null), ',') as flags from documents""")
def injection_flags(spark, d):
    p = _SHAPES
    return table(spark, d, "documents").select("doc_id", F.array_join(S.injection_flags("text", p["json_shape"], p["keyword"], p["role"], p["instruction"]), ",").alias("flags"))


@query("""with t as (select conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 and not list_contains([{stop}], w))) as w from conversations where role = 'user')
select a.conv_id, a.turn, round(coalesce(max(case when least(len(a.w), len(b.w)) > 0 then len(list_filter(a.w, lambda x: list_contains(b.w, x))) / least(len(a.w), len(b.w)) else 0.0 end), 0.0), 6) as repeat
from t a left join t b on a.conv_id = b.conv_id and b.turn < a.turn group by 1, 2""".replace("{stop}", ", ".join(f"'{w}'" for w in S.ASK_STOP)))
def repeated_questions(spark, d):
    from ..operators.windows import asked_before

    t = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", S.ask_words("text").alias("words"))
    return asked_before(t, ["conv_id"], "turn", "words", S.overlap).select("conv_id", "turn", F.round("repeat", 6).alias("repeat"))


@query("""with i as (select l_orderkey, list(cast(l_partkey as int) order by l_linenumber, l_partkey) as ids from lineitem group by 1) select l_orderkey, array_to_string(case when len(ids) >= 5 then ids[len(ids) - 4 : len(ids)] else list_concat(list_resize([0], 5 - len(ids), 0), ids) end, ',') as padded from i""")
def padded_ids(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("int")).alias("ids"))
    return i.select("l_orderkey", F.array_join(M.pad_left(F.col("ids"), 5, 0).cast("array<string>"), ",").alias("padded"))


@query()
def parse_replies(spark, d):
    """Replies made of conversation texts, through the parsers that need Python."""
    t = table(spark, d, "conversations").where("role = 'assistant'")
    answer = F.to_json(F.struct(F.col("text").alias("verdict"), F.struct(F.lit(1).alias("a")).alias("n")))
    reply = F.when(F.col("text").isNotNull(), F.concat(F.lit("<think>x</think> noise "), answer, F.lit(" tail")))
    found = t.select("conv_id", "turn", S.first_object(reply).alias("object"), S.ask_shape("text").alias("shape"), S.nfkc("text").alias("nfkc"))
    return found.select("conv_id", "turn", F.get_json_object("object", "$.n.a").alias("n"), "shape.sentences", "shape.questions", "nfkc")


@query()
def replay_export(spark, d):
    """Training rows of replayed episodes: counters before each turn, rewards and what is done."""
    from ..operators import credit as C
    from ..operators import windows as W
    from .credit import turns

    t = W.running_counts(turns(spark, d), ["conv_id"], "turn", asks=F.col("role") == "user", answers=F.col("role") == "assistant")
    return C.terminal_rows(t, ["conv_id"], "turn", "reward", F.col("size") / 1000).where("role = 'assistant'").select("conv_id", "turn", "asks", "answers", F.round("step_reward", 6).alias("step_reward"), "done", "valid")



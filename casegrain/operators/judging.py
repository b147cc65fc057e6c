"""Graders: scores from match levels, panels, ontology floors and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio

CORE, PARTIAL = 0.85, 0.50
GAP, SURE, UNSURE = 0.35, 0.85, 0.5
MAX_PANEL = 64
WEIGHT = {"FULL": 1.0, "CORE": 0.85, "PARTIAL": 0.5, "NONE": 0.0}
_RANK = {"partial": 1, "core": 2, "full": 3}


def level_scores(gt: Column, pred: Column, full: Column, core: Column, partial: Column) -> dict[str, Column]:
    """Set-similarity scores of graded matches; more matches than items raise an error."""
    matched = full + core + partial
    tp = F.when((matched > gt) | (matched > pred), F.raise_error(F.lit("more matches than items")).cast("double")).otherwise(full + F.lit(CORE) * core + F.lit(PARTIAL) * partial)
    fp, fn = F.greatest(F.lit(0.0), pred - tp), F.greatest(F.lit(0.0), gt - tp)
    tversky = lambda a, b: ratio(tp, tp + F.lit(a) * fp + F.lit(b) * fn)
    return {
        "soft_tp": tp,
        "t_reward": tversky(0.3, 0.7),
        "tversky_balanced": tversky(0.5, 0.5),
        "tversky_fp_heavy": tversky(0.7, 0.3),
        "jaccard_weighted": ratio(tp, tp + fp + fn),
        "jaccard_count": ratio(matched, gt + pred - matched),
        "dice": ratio(2 * tp, 2 * tp + fp + fn),
        "acc": ratio(tp, F.greatest(gt, pred)),
        "acc_exact": ((full == gt) & (gt == pred)).cast("double"),
        "acc_strict": (full == gt).cast("double"),
        "acc_lenient": (full + core == gt).cast("double"),
    }


def count_level(matches: Column, level: str) -> Column:
    return F.size(F.filter(matches, lambda m: F.lower(m["level"]) == level))


def majority(c: str) -> Column:
    """1 if at least half the graders (rounded up) say 1, as an aggregate; null if none votes."""
    votes = F.sum(F.col(c).cast("int"))
    return (votes >= F.ceil(F.count("*") / 2)).cast("int")


def panel(scores: DataFrame, case: str, means: list[str], votes: list[str]) -> DataFrame:
    """Means and majority votes of each case over its graders; a missing metric is left out of its mean."""
    return scores.groupBy(case).agg(F.count("*").alias("graders"), *[F.avg(m).alias(m) for m in means], *[majority(v).alias(v) for v in votes])


def floor_level(verdict: Column, confidence: Column) -> Column:
    """The least match level that an ontology verdict justifies."""
    v = F.upper(verdict)
    return F.when(v == "FULL", F.when(F.lower(confidence) == "high", "full").otherwise("core")).when(v == "CORE", "core")


def raise_levels(levels: Column, floor: Column, blank: Column) -> Column:
    """Levels lifted to the floor; the floor alone if there are none; unchanged if blank or no floor."""
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    lifted = F.transform(levels, lambda v: F.when(F.coalesce(rank[v], F.lit(0)) >= rank[floor], v).otherwise(floor))
    return F.when(floor.isNull() | blank, levels).when(F.size(levels) == 0, F.array(floor)).otherwise(lifted)


def fuse(details: DataFrame) -> DataFrame:
    """Median reward of each case before and after its floor.

    Rows are (case_id, grader, gt, pred, levels, verdict, confidence, blank).
    """
    floor = floor_level(F.col("verdict"), F.col("confidence"))
    def count_of(c: str, level: str) -> Column:
        return F.size(F.filter(F.col(c), lambda v: v == level))

    counts = lambda c: [count_of(c, x) for x in ("full", "core", "partial")]
    up = details.withColumn("up", raise_levels(F.col("levels"), floor, F.col("blank")))
    injected = (F.size("levels") == 0) & (F.size("up") > 0)
    gt, pred = (F.when(injected, F.greatest(F.lit(1), F.col(c))).otherwise(F.col(c)) for c in ("gt", "pred"))
    scored = up.select("case_id", level_scores(F.col("gt"), F.col("pred"), *counts("levels"))["t_reward"].alias("pre"), level_scores(gt, pred, *counts("up"))["t_reward"].alias("post"))
    return scored.groupBy("case_id").agg(F.median("pre").alias("median_pre"), F.median("post").alias("median_post"))


def disagreement(median: Column, verdict: Column) -> Column:
    """hard, soft or null: how far graders and ontology are apart."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.upper(verdict)]
    hard = ((weight >= SURE) & (median < UNSURE)) | ((weight == 0) & (median >= SURE))
    return F.when(weight.isNull() | (F.abs(median - weight) < GAP), None).when(hard, "hard").otherwise("soft")


def board(cases: DataFrame) -> DataFrame:
    """Disagreements in reading order: hard ones first, then by gap, then by case."""
    return cases.where("kind is not null").orderBy(F.when(F.col("kind") == "hard", 0).otherwise(1), F.desc("gap"), F.coalesce("case_id", F.lit("")))


def pairs_of(items: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, a, b, a_value, b_value): unordered pairs of a panel's graders.

    A panel is a few graders; one of more than ``MAX_PANEL`` is an error. One
    shuffle by group instead of a self-join.
    """
    panel_ = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    held = items.groupBy(group).agg(panel_.alias("p")).withColumn("p", F.when(F.size("p") > MAX_PANEL, F.raise_error(F.lit("too many graders in a panel"))).otherwise(F.col("p")))
    later = F.transform("p", lambda x, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return held.select(group, F.explode(F.flatten(later)).alias("q")).select(group, F.col("q.x.k").alias("a"), F.col("q.y.k").alias("b"), F.col("q.x.v").alias("a_value"), F.col("q.y.v").alias("b_value"))


def deduped_verdicts(pairs: DataFrame, judge) -> DataFrame:
    """Judge each distinct lower-cased (pred, gold) once and join the verdict back."""
    keyed = pairs.withColumn("_p", F.lower("pred")).withColumn("_g", F.lower("gold"))
    return keyed.join(judge(keyed.select("_p", "_g").distinct()), ["_p", "_g"], "left").drop("_p", "_g")


def best_matches(matches: Column, limit: Column) -> Column:
    """Greedy one-to-one matches by level, first come first, at most ``limit``.

    ``matches`` are structs (level, gt, pred).
    """
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    ranked = F.array_sort(F.transform(matches, lambda m, i: F.struct((-rank[F.lower(m["level"])]).alias("r"), i.alias("i"), m.alias("m"))))
    empty = F.filter(matches, lambda m: F.lit(False))

    def step(taken, x):
        used = F.exists(taken, lambda t: (t["gt"] == x["m"]["gt"]) | (t["pred"] == x["m"]["pred"]))
        return F.when(used | (F.size(taken) >= limit), taken).otherwise(F.concat(taken, F.array(x["m"])))

    return F.aggregate(ranked, empty, step)


def step_counters(calls: DataFrame) -> DataFrame:
    """Calls, fallbacks and flags of each step, and their running totals."""
    by = calls.groupBy("step").agg(F.count("*").alias("calls"), F.count_if("fallback").alias("fallbacks"), F.count_if("flagged").alias("flagged"))
    run = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row a step
    return by.withColumns({f"total_{c}": F.sum(c).over(run) for c in ("calls", "fallbacks", "flagged")})


def _median(c: Column) -> Column:
    """Median of an array's numbers; null for none."""
    given = F.array_sort(F.filter(c, lambda x: x.isNotNull()))
    n = F.size(given)
    return (F.get(given, F.floor((n - 1) / 2).cast("int")) + F.get(given, F.floor(n / 2).cast("int"))) / 2


def verdict_ladder(cases: DataFrame, bar: float = 0.85, least: int = 3, veto_cap: float = 0.5) -> DataFrame:
    """Adds prefusion, fused, dx_score, source, vetoed and cached to cases that graders and the ontology have judged.

    Reads ``scores`` (a reward a grader, null where the reply could not be read),
    ``lifted`` (the same above the ontology's floor), ``veto`` and ``fallback``
    (the ontology's own score). The median of the scores is lifted only below the
    bar; at the bar the case counts in full, unless a veto caps it. A panel of
    fewer than ``least`` read replies gives way to the ontology's score, and such
    a block is not to be cached.
    """
    thin = F.coalesce(F.size(F.filter("scores", lambda x: x.isNotNull())), F.lit(0)) < least
    out = cases.withColumn("prefusion", _median(F.col("scores"))).withColumn("fused", F.when(thin | (F.col("prefusion") >= bar), F.col("prefusion")).otherwise(_median(F.col("lifted"))))
    full = F.col("fused") >= bar
    vetoed = ~thin & full & F.coalesce(F.col("veto"), F.lit(False))
    score = F.when(thin, F.col("fallback")).when(vetoed, veto_cap).when(full, 1.0).otherwise(0.0)
    return out.withColumns({"dx_score": score, "source": F.when(thin, "ontology_fallback").otherwise("panel"), "vetoed": vetoed, "cached": ~thin})

"""Served assets, validation rows, episode metrics and recovery of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("answer", "corrupt", "ook")


def imaged_items(items: DataFrame, images: DataFrame, case: str) -> DataFrame:
    """Items of cases that carry one of their case's images."""
    return items.where("image_id is not null").join(images.select(case, "image_id").distinct(), [case, "image_id"], "left_semi")


def served_assets(items: DataFrame, manifest: DataFrame | None, files: DataFrame | None, whole_figure: bool) -> DataFrame:
    """Adds ``status``, ``asset_id`` and ``asset_path`` by (image_id, panel_id).

    A group's crop comes before the panel's; without either file the policy
    serves the whole figure or nothing. ``files`` lists the paths that exist.
    """
    if manifest is None:
        return items.withColumn("status", F.lit("off")).withColumn("asset_id", F.col("image_id")).withColumn("asset_path", F.col("figure_path"))
    there = files.select(F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    m = manifest.select("image_id", F.col("panel_id").cast("string").alias("panel_id"), "panel_asset_id", "crop_path", "group_asset_id", "group_crop_path", F.lit(True).alias("_bound"))
    both = items.withColumn("panel_id", F.col("panel_id").cast("string")).join(m, ["image_id", "panel_id"], "left")
    both = both.join(there.withColumnsRenamed({"_p": "group_crop_path", "_there": "_group"}), "group_crop_path", "left").join(there.withColumnsRenamed({"_p": "crop_path", "_there": "_crop"}), "crop_path", "left")
    named = F.coalesce(F.col("image_id") != "", F.lit(False)) & F.coalesce(F.col("panel_id") != "", F.lit(False))
    status = F.when(~named, "no_panel_id").when(F.col("_bound").isNull(), "unbound").when(F.col("_group") | F.col("_crop"), "crop").otherwise("missing_file")
    pick = lambda group, crop, whole: F.when(F.col("status") == "crop", F.when(F.col("_group"), F.col(group)).otherwise(F.col(crop))).otherwise(F.col(whole) if whole_figure else F.lit(None))
    out = both.withColumn("status", status)
    return out.withColumn("asset_id", pick("group_asset_id", "panel_asset_id", "image_id")).withColumn("asset_path", pick("group_crop_path", "crop_path", "figure_path")).select(*items.columns, "status", "asset_id", "asset_path")


def status_counts(served: DataFrame) -> DataFrame:
    return served.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.slice(F.collect_set("case_id"), 1, 20)).alias("examples"))


def menu_records(asked: DataFrame, menu: DataFrame, records: DataFrame, case: str) -> DataFrame:
    """Records that each asked menu item stands for, by (l1, category)."""
    return asked.join(menu, "item").join(records, [case, "l1", "category"])


def pending_consults(records: DataFrame, released: DataFrame, case: str, department: Column) -> DataFrame:
    """Verified records of a department that came back and aren't released yet."""
    return records.where(F.col("returned") & F.col("verified") & department).join(released.select(case, "rid"), [case, "rid"], "left_anti")


def validation_rows(pool: DataFrame, budgets: dict, batch: int) -> DataFrame:
    """Rows with the evaluation's budgets; corrupt ones get a seed that never changes."""
    n = pool.count()
    if not n or batch <= 0 or n % batch:
        raise ValueError(f"{n} rows are no positive multiple of {batch}")
    kind = F.coalesce("task_kind", F.lit("answer"))
    bad = pool.where(~kind.isin(*KINDS)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown task kind {bad[0].task_kind!r}")
    corrupt = F.col("task_kind") == "corrupt"
    rows = pool.withColumn("task_kind", kind).withColumns({k: F.lit(v) for k, v in budgets.items()})
    return rows.withColumn("corrupt_rate", corrupt.cast("double")).withColumn("corrupt_seed", F.when(corrupt, F.coalesce("corrupt_seed", F.concat(F.lit("val-"), "case_id"))).otherwise("0"))


def episode_metrics(turns: DataFrame, key: list[str]) -> DataFrame:
    """Counts, sums and sets of each episode's turns (verb, phase, fallback, reward, released)."""
    by = turns.groupBy(*key, "verb").agg(F.count("*").alias("n"), F.count_if("fallback").alias("fallbacks"), F.count_if(F.col("reward") < 0).alias("invalid"), F.sum("reward").alias("reward"), F.sum(F.coalesce(F.size("released"), F.lit(0))).alias("released"), F.count_if(F.col("phase") == "workup").alias("workup"))
    return by.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("verb", "n")))).alias("actions_by_verb"), F.sum("n").alias("turns"), F.sum("fallbacks").alias("fallbacks"), F.sum("invalid").alias("invalid_turns"), F.round(F.sum("reward"), 4).alias("reward_sum"),
        F.sum("released").alias("reports_released"), F.sum("workup").alias("workup_turns"),
    )


def anchor_collisions(turns: DataFrame, group: str, anchor: str, turn: str) -> DataFrame:
    """Anchors that occur twice or more in a group, openers left out."""
    return turns.where(F.col(turn) > 0).groupBy(group, anchor).agg(F.count("*").alias("n")).where("n >= 2")


def recovered(plans: DataFrame, chunk_steps: int, resume: int, contract: str) -> DataFrame:
    """Plan rows of the chunks used before a step, which must all be there under one contract."""
    need = -(-resume // chunk_steps)
    have = {r.chunk: r.contract for r in plans.where(F.col("chunk") < need).groupBy("chunk").agg(F.max("contract").alias("contract")).collect()}  # a row a chunk
    missing = [k for k in range(need) if k not in have]
    if missing:
        raise RuntimeError(f"no plan for chunks {missing}")
    other = [k for k, c in have.items() if c != contract]
    if other:
        raise RuntimeError(f"chunks {other} were planned under another contract")
    return plans.where(F.col("chunk") < need).orderBy("step", "case")


def page_of(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def terse(reason: Column, rules: list[tuple[str, str]], most: int = 80) -> Column:
    """The first rule's short form, else the first clause, cut to a length."""
    clause = F.substring(F.element_at(F.split(F.coalesce(reason, F.lit("")), "[;.]"), 1), 1, most)
    out = clause
    for start, short in reversed(rules):
        out = F.when(F.coalesce(reason, F.lit("")).startswith(start), short).otherwise(out)
    return out


SCORERS: dict = {}


def scorer(name: str):
    """Registers a function (gold, answer) of columns that gives a score column."""

    def add(f):
        SCORERS[name] = f
        return f

    return add


def score_by(name: str, gold: Column, answer: Column) -> Column:
    if name not in SCORERS:
        raise KeyError(f"no scorer {name!r}; there are {sorted(SCORERS)}")
    return SCORERS[name](gold, answer)


def overridden(base: Column, override: Column) -> Column:
    """A map with the entries of another over its own; either may be null."""
    none = F.create_map().cast("map<string,string>")
    over = F.coalesce(override, none)
    return F.map_concat(F.map_filter(F.coalesce(base, none), lambda k, _: ~F.map_contains_key(over, k)), over)

"""Returns and advantages of episode groups.

Rows are turns: (group, traj, turn, reward, anchor). Windows are by group or
trajectory, so their size is a group's, not the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def discounted(turns: DataFrame, keys: list[str], turn: str, reward: str, gamma: float) -> DataFrame:
    """Adds ``ret``, the discounted sum of this and later rewards.

    A fold over the trajectory's reward array, so long trajectories lose no
    precision to powers of gamma.
    """
    empty = F.array().cast("array<double>")
    step = lambda a, x: F.array_append(a, x + F.lit(gamma) * F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))
    rows = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(reward).cast("double").alias("r")))).alias("rows"))
    back = F.aggregate(F.reverse(F.transform("rows", lambda x: x["r"])), empty, step)
    zipped = rows.select(*keys, F.explode(F.arrays_zip(F.transform("rows", lambda x: x["t"]).alias("t"), F.transform("rows", lambda x: x["r"]).alias("r"), F.reverse(back).alias("g"))).alias("z"))
    return zipped.select(*keys, F.col("z.t").alias(turn), F.col("z.r").alias(reward), F.col("z.g").alias("ret"))


def local_penalty(reward: Column, invalid: Column, coef: float = 0.1) -> tuple[Column, Column]:
    """(reward without its negative part, penalty of the row) of the local penalty mode."""
    return F.greatest(F.lit(0.0), reward), F.when(invalid, F.lit(-coef)).otherwise(F.lit(0.0))


def normalised(value: Column, w: Window, mode: str, floor: float = 0.1, epsilon: float = 0.0) -> Column:
    """A value against its group: mean, mean_std or mean_std_floor, with the sample deviation.

    0 for a group of one and where the deviation is 0.
    """
    if mode not in ("mean", "mean_std", "mean_std_floor"):
        raise ValueError(f"unknown mode {mode!r}")
    centred = value - F.avg(value).over(w)
    if mode == "mean":
        return centred
    sd = F.stddev_samp(value).over(w)
    by = F.greatest(sd, F.lit(floor)) if mode == "mean_std_floor" else sd
    return F.when(F.count(value).over(w) < 2, 0.0).when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(F.try_divide(centred, by + F.lit(epsilon)))


def episode_advantage(totals: DataFrame, group: str, total: str, mode: str) -> DataFrame:
    """Adds ``adv_episode`` to rows of one trajectory each."""
    return totals.withColumn("adv_episode", normalised(F.col(total), Window.partitionBy(group), mode))


def step_advantage(turns: DataFrame, group: str, traj: str, turn: str, anchor: str, value: str, mode: str) -> DataFrame:
    """Adds ``adv_step``: a turn against the group's turns of the same anchor.

    The anchor that opens the group's first trajectory is left out, and a
    bucket of one turn counts 0.
    """
    opener = turns.groupBy(group).agg(F.min_by(anchor, F.struct(traj, turn)).alias("_opener"))
    w = Window.partitionBy(group, anchor)
    return turns.join(opener, group).withColumn("adv_step", F.when(F.col(anchor) == F.col("_opener"), 0.0).when(F.count("*").over(w) < 2, 0.0).otherwise(normalised(F.col(value), w, mode))).drop("_opener")


def joint_advantage(turns: DataFrame, omega: float) -> DataFrame:
    return turns.withColumn("adv", F.col("adv_episode") + F.lit(omega) * F.col("adv_step"))


def unpenalised_vote(rows: DataFrame, group: str, traj: str, score: str) -> DataFrame:
    """Each trajectory's best score, and the mean and deviation of these in its group."""
    best = rows.groupBy(group, traj).agg(F.max(score).alias("vote"))
    w = Window.partitionBy(group)
    return best.withColumn("vote_mean", F.avg("vote").over(w)).withColumn("vote_std", F.coalesce(F.stddev_samp("vote").over(w), F.lit(0.0)))


def pad_masked(rows: DataFrame, group: str, pad: str, value: str) -> DataFrame:
    """Adds ``adv``: the value against the mean of the group's rows that aren't padding; 0 for padding."""
    mean = F.avg(F.when(~F.col(pad), F.col(value))).over(Window.partitionBy(group))
    return rows.withColumn("adv", F.when(F.col(pad), 0.0).otherwise(F.col(value) - mean))


def flag_boost(rows: DataFrame, traj: str, flag: str, eligible: Column, value: str, scale: float) -> DataFrame:
    """Adds ``traj_flag``, whether any row of the trajectory has the flag, and ``boosted``."""
    any_flag = F.max(F.col(flag)).over(Window.partitionBy(traj))
    return rows.withColumn("traj_flag", any_flag).withColumn("boosted", F.when(F.col("traj_flag") & eligible & (F.col(value) > 0), F.col(value) * scale).otherwise(F.col(value)))


def with_variance(rows: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """Rows of the groups in which the value, rounded, isn't the same throughout."""
    kept = rows.groupBy(group).agg(F.count_distinct(F.round(value, digits)).alias("_n")).where("_n > 1").select(group)
    return rows.join(kept, group, "left_semi")


def terminal_rows(turns: DataFrame, keys: list[str], turn: str, reward: str, outcome: Column) -> DataFrame:
    """Adds ``done`` to each last turn, its reward with the outcome, and ``valid``."""
    w = Window.partitionBy(*keys).orderBy(turn)
    last = F.lead(turn).over(w).isNull()
    return turns.withColumn("done", last).withColumn("step_reward", F.when(F.col("done"), F.col(reward) + outcome).otherwise(F.col(reward))).withColumn("valid", F.col(reward) >= 0)


def anchor_key(anchor: Column, row: Column) -> Column:
    """The turn's own anchor, or one that groups with nothing."""
    return F.coalesce(anchor, F.concat(F.lit("noanchor:"), row.cast("string")))


def group_telemetry(turns: DataFrame, group: str, anchor: str, adv: str) -> DataFrame:
    """Step groups of each group: distinct, collided, and the spread of advantages (of a sample; null for one)."""
    per = turns.groupBy(group, anchor).agg(F.count("*").alias("n"), F.sum(adv).alias("s"), F.sum(F.col(adv).cast("double") * F.col(adv)).alias("s2"), F.max(adv).alias("hi"), F.min(adv).alias("lo"), F.count_if(F.col(adv) != 0).alias("nz"))
    mean = F.try_divide(F.sum("s"), F.sum("n"))
    return per.groupBy(group).agg(
        F.count("*").alias("distinct_steps"), F.count_if(F.col("n") > 1).alias("collided"), mean.alias("adv_mean"), F.sqrt(F.try_divide(F.greatest(F.sum("s2") - mean * F.sum("s"), F.lit(0.0)), F.sum("n") - 1)).alias("adv_std"),
        F.max("hi").alias("adv_max"), F.min("lo").alias("adv_min"), F.sum("nz").alias("nonzero"),
    )

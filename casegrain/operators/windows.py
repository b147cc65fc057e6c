"""Positions, running counts and batches inside an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_counts(turns: DataFrame, keys: list[str], turn: str, **kinds: Column) -> DataFrame:
    """Adds, for each named condition, how many earlier turns of the episode meet it."""
    before = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumns({name: F.coalesce(F.count_if(hit).over(before), F.lit(0)) for name, hit in kinds.items()})


def alias_by_first(rows: DataFrame, episode: str, asset: str, order: list[str], prefix: str) -> DataFrame:
    """(episode, asset, alias): numbers by first appearance in the episode, from 1."""
    first = rows.groupBy(episode, asset).agg(F.min(F.struct(*order)).alias("_at"))
    n = F.row_number().over(Window.partitionBy(episode).orderBy("_at", asset))
    return first.select(episode, asset, F.concat(F.lit(prefix), n.cast("string")).alias("alias"))


def inverse(aliases: Column) -> Column:
    return F.map_from_arrays(F.map_values(aliases), F.map_keys(aliases))


def new_facts(rows: DataFrame, episode: str, fact: str, order: list[str]) -> DataFrame:
    """Adds ``is_new``, and ``streak``: how many rows in a row, this one included, brought nothing new."""
    seen = Window.partitionBy(episode, fact).orderBy(*order)
    line = Window.partitionBy(episode).orderBy(*order)
    marked = rows.withColumn("is_new", F.row_number().over(seen) == 1)
    island = marked.withColumn("_i", F.count_if("is_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = Window.partitionBy(episode, "_i").orderBy(*order)
    return island.withColumn("streak", F.row_number().over(at) - F.when(F.col("_i") > 0, 1).otherwise(0)).drop("_i")


def delivery_plan(items: DataFrame, episode: str, asset: str, order: list[str], eligible: Column, budget: int, chunk: int) -> DataFrame:
    """The first row of each asset, eligible ones first, cut to the budget, with ``batch``.

    Rows are dealt by episode once, which serves both windows.
    """
    once = items.repartition(episode).withColumn("_first", F.row_number().over(Window.partitionBy(episode, asset).orderBy(*order))).where("_first = 1").withColumn("_late", (~eligible).cast("int"))
    place = F.row_number().over(Window.partitionBy(episode).orderBy("_late", *order))
    return once.withColumn("place", place).where(F.col("place") <= budget).withColumn("batch", F.floor((F.col("place") - 1) / chunk).cast("int")).drop("_first", "_late")


def rolling_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Adds the mean and number of the last ``size`` values, this one included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)
    return rows.withColumn("window_mean", F.avg(value).over(w)).withColumn("window_n", F.count(value).over(w))


def attempts(rows: DataFrame, step: str, order: list[str]) -> DataFrame:
    """Adds ``attempt``: how many rows of the step came before, from 0."""
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(step).orderBy(*order)) - 1)


def asked_before(turns: DataFrame, keys: list[str], turn: str, words: str, overlap) -> DataFrame:
    """Adds ``repeat``: the greatest overlap of a question's words with an earlier one's."""
    before = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    seen = turns.withColumn("_seen", F.collect_list(words).over(before))
    best = F.array_max(F.transform("_seen", lambda w: overlap(F.col(words), w)))
    return seen.withColumn("repeat", F.coalesce(best, F.lit(0.0))).drop("_seen")


def rendered(rows: DataFrame, keys: list[str], order: list[str], line: Column, separator: str = "\n") -> DataFrame:
    """One text of each group's lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), separator).alias("text"))


def top_n(rows: DataFrame, cls: str, n: int, by: str, tie: str) -> DataFrame:
    """The n rows of each class with the greatest value, then the least tie-break."""
    place = F.row_number().over(Window.partitionBy(cls).orderBy(F.desc(by), tie))
    return rows.withColumn("place", place).where(F.col("place") <= n)

"""Joins by order, range, absence and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a configuration table (phases, lineage, chapters) that may be sent to every task.
MAX_CONFIG_ROWS = 10_000


def config_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table made on the driver and safe to broadcast: its size is checked."""
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a configuration table")
    return F.broadcast(spark.createDataFrame(rows, schema))


def latest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in input order."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(packed, order).alias("_r")).select("_r.*")


def left_by_key(records: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Every record with its case, and ``matched``."""
    return records.join(cases.withColumn("_hit", F.lit(True)), key, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def pending(cases: DataFrame, rollouts: int, done: DataFrame, keys: list[str]) -> DataFrame:
    """(case, rollout) pairs not done yet; rollouts are a fixed small number a case."""
    every = cases.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1))))
    return every.join(done, keys, "left_anti")


def as_of(rows: DataFrame, at: Column, spark: SparkSession, lineage: list[tuple[int, int]]) -> DataFrame:
    """Adds ``generation``: that of the latest lineage entry not after ``at``, or the first entry's."""
    entries = sorted(lineage) or [(0, 0)]
    starts = [None, *[a for a, _ in entries[1:]]]
    ranges = [(a, b, g) for a, b, (_, g) in zip(starts, [*starts[1:], None], entries)]
    table = config_table(spark, ranges, "lo bigint, hi bigint, generation bigint")
    inside = (F.col("lo").isNull() | (F.col("lo") <= at)) & (F.col("hi").isNull() | (at < F.col("hi")))
    return rows.join(table, inside, "left").drop("lo", "hi")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its keys not after it, for tables of any size.

    Both sides are merged and the last right row carried forward, one sort by
    key and time instead of a pair for each candidate.
    """
    pack = F.struct(*[F.col(v) for v in values])
    kind = right.select(*[F.col(c) for c in values]).schema.simpleString()
    a = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(kind))
    b = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_side"), pack.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return merged.where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def phase_bounds(fractions: list[float], chunk: int, total: int) -> list[tuple[int, int]]:
    """[start, end) of each phase, on the chunk grid; the last phase takes what is left."""
    n = max(len(fractions), total // chunk)
    out, start, share = [], 0, 0.0
    for i, f in enumerate(fractions):
        share += f
        stop = n if i == len(fractions) - 1 else max(start // chunk + 1, round(share * n))
        end = min(stop * chunk, n * chunk)
        out.append((start, end))
        start = end
    return out


def by_phase(rows: DataFrame, step: Column, spark: SparkSession, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds ``phase``: the range that holds the step, or the last beyond the end."""
    table = config_table(spark, [(i, a, b) for i, (a, b) in enumerate(bounds)], "phase int, lo bigint, hi bigint")
    found = rows.join(table, (F.col("lo") <= step) & (step < F.col("hi")), "left")
    return found.withColumn("phase", F.coalesce("phase", F.lit(len(bounds) - 1))).drop("lo", "hi")


def code_number(code: Column) -> Column:
    """letter * 100 + two digits of a classification code; null for other texts."""
    c = F.upper(F.trim(code))
    return F.when(c.rlike("^[A-Z][0-9]{2}"), F.ascii(c) * 100 + F.substring(c, 2, 2).cast("int"))


def chapter_of(rows: DataFrame, code: str, chapters: DataFrame) -> DataFrame:
    """Adds ``chapter``: the first listed range (lo, hi, ord, chapter) that holds the code."""
    if chapters.limit(MAX_CONFIG_ROWS + 1).count() > MAX_CONFIG_ROWS:
        raise ValueError("too many chapters for a configuration table")
    distinct = rows.select(F.col(code).alias("_code")).distinct().withColumn("_n", code_number(F.col("_code")))
    hit = distinct.join(F.broadcast(chapters), F.col("_n").between(F.col("lo"), F.col("hi"))).groupBy("_code").agg(F.min_by("chapter", "ord").alias("chapter"))
    return rows.join(hit, F.col(code) == F.col("_code"), "left").drop("_code")


def by_ladder(rows: DataFrame, key: Column, rungs: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Adds ``code`` and ``method`` from the first rung (table, key column, method) that has the key.

    Of a key's rows the first by ``ord`` is taken, or without that column the least code.
    """
    out, code, method = rows, [], []
    for i, (table, k, name) in enumerate(rungs):
        out = out.join(table.groupBy(F.col(k).alias(f"_k{i}")).agg((F.min_by("code", "ord") if "ord" in table.columns else F.min("code")).alias(f"_c{i}")), key == F.col(f"_k{i}"), "left")
        code.append(F.col(f"_c{i}"))
        method.append(F.when(F.col(f"_c{i}").isNotNull(), name))
    return out.withColumn("code", F.coalesce(*code)).withColumn("method", F.coalesce(*method)).drop(*[f"_{x}{i}" for i in range(len(rungs)) for x in "kc"])


def total_lookup(rows: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Inner lookup that fails if a row has no entry."""
    missing = rows.join(dim, keys, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"no entry for {missing[0].asDict()}")
    return rows.join(dim, keys)


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if not a.join(b, key, "left_semi").isEmpty():
        raise ValueError(f"tables share values of {key}")


def mixed_groups(rows: DataFrame, group: str, scorer: str) -> DataFrame:
    """Groups with more than one distinct scorer, and which."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(scorer)).alias("scorers")).where("size(scorers) > 1")


def custom_id(key: Column) -> Column:
    """A key as a batch service takes it: other characters than letters, digits, _ and - as _, 64 of them."""
    return F.substring(F.regexp_replace(key, "[^A-Za-z0-9_-]", "_"), 1, 64)


def by_custom_id(pairs: DataFrame, replies: DataFrame, key: str, order: str) -> DataFrame:
    """Pairs with the reply of their custom id.

    Keys that share an id share its reply, the last by ``order``, and are marked ``shared_id``.
    """
    last = replies.groupBy("custom_id").agg(F.max_by("reply", order).alias("reply"))
    named = pairs.withColumn("custom_id", custom_id(F.col(key)))
    keys = named.groupBy("custom_id").agg((F.min(key) != F.max(key)).alias("shared_id"))
    return named.join(keys, "custom_id").join(last, "custom_id", "left")


def replies_joined(pairs: DataFrame, replies: DataFrame, key: str, graders: list[str]) -> tuple[DataFrame, DataFrame]:
    """(every pair and grader with its reply or null, counts of parsed, failed and missing by grader)."""
    every = pairs.withColumn("grader", F.explode(F.array(*map(F.lit, graders))))
    joined = every.join(replies, [key, "grader"], "left")
    counts = joined.groupBy("grader").agg(F.count_if(F.col("ok")).alias("parsed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("missing"))
    return joined, counts


def greedy_lines(lines: Column, records: Column) -> Column:
    """Record position for each observed line, in order: first an unused one of the same name and
    category, else an unused one of the same asset; -1 if none is left."""

    def step(acc, line):
        n = F.size(records)
        free = lambda i: ~F.array_contains(acc["used"], i)
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        strict = F.filter(index, lambda i: free(i) & (F.get(records, i)["name"] == line["name"]) & (F.get(records, i)["category"] == line["category"]))
        loose = F.filter(index, lambda i: free(i) & (F.get(records, i)["asset"] == line["asset"]))
        pick = F.coalesce(F.get(strict, F.lit(0)), F.get(loose, F.lit(0)), F.lit(-1))
        return F.struct(F.array_append(acc["used"], F.when(pick >= 0, pick)).alias("used"), F.array_append(acc["out"], pick).alias("out"))

    none = F.array().cast("array<int>")
    return F.aggregate(lines, F.struct(none.alias("used"), none.alias("out")), step, lambda acc: acc["out"])


def swap_candidates(victims: DataFrame, donors: DataFrame, seed: str) -> DataFrame:
    """A donor of another category for each victim, chosen by hash.

    Donors are numbered within their category; a victim draws a category among
    the others, then a donor in it, so no victim meets all donors.
    """
    w = Window.partitionBy("category").orderBy("donor_id")
    numbered = donors.withColumn("_n", F.row_number().over(w) - 1)
    sizes = sorted((r.category, r["count"]) for r in donors.groupBy("category").count().collect())  # a row a category
    if not sizes:
        return victims.select("*", F.lit(None).cast("string").alias("donor_category"), F.lit(None).cast("string").alias("donor_id"))
    every = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")) for c, n in sizes])
    h = lambda tag: F.xxhash64("victim_id", F.lit(seed), F.lit(tag))
    others = F.filter(every, lambda x: x["c"] != F.col("category"))
    drawn = victims.withColumn("_o", F.when(F.size(others) > 0, F.get(others, F.pmod(h("c"), F.size(others)).cast("int"))))
    slot = drawn.withColumn("_slot", F.pmod(h("d"), F.col("_o.n")).cast("int")).withColumn("_oc", F.col("_o.c"))
    picked = numbered.select(F.col("category").alias("_oc"), F.col("_n").alias("_slot"), "donor_id")
    return slot.join(picked, ["_oc", "_slot"], "left").withColumnRenamed("_oc", "donor_category").drop("_o", "_slot")

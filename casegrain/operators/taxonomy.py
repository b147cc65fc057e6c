"""Roll-ups of classified mentions over category levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_rule


def classified(mentions: DataFrame, surface: str, rules: list[tuple[str, str]], into: str, default: str) -> DataFrame:
    """Adds the rule list's label; each distinct surface form is matched once."""
    forms = mentions.select(surface).distinct().withColumn(into, first_rule(surface, rules, default))
    joined = mentions.join(forms, mentions[surface].eqNullSafe(forms[surface]), "left")
    return joined.drop(forms[surface])


def exploded(cases: DataFrame, key: str, sections: dict[str, str], item: str) -> DataFrame:
    """One row for each item of the cases' JSON sections: (key, section, item.*)."""
    parts = [cases.select(key, F.lit(name).alias("section"), F.explode(F.from_json(column, f"array<{item}>")).alias("item")) for name, column in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "section", "item.*")


def rollup(mentions: DataFrame, l1: str, l2: str, concept: str, case: str) -> DataFrame:
    """Counts at (l1, l2) and (l1, l2, concept): mentions, cases and concepts, each distinct anew."""
    one = mentions.groupBy(l1, l2, concept, case).agg(F.count("*").alias("n"))
    fine = one.groupBy(l1, l2, concept).agg(F.sum("n").alias("mentions"), F.count_distinct(case).alias("cases"), F.lit(1).cast("bigint").alias("concepts"))
    coarse = one.groupBy(l1, l2).agg(F.sum("n").alias("mentions"), F.count_distinct(case).alias("cases"), F.count_distinct(concept).alias("concepts")).withColumn(concept, F.lit(None).cast("string"))
    return fine.withColumn("level", F.lit(3)).unionByName(coarse.withColumn("level", F.lit(2)))


def coded_share(concepts: DataFrame, category: str, code: str, mentions: str) -> DataFrame:
    """Concepts, mentions and the percentage of mentions with a code, by category."""
    coded = F.sum(F.when(F.col(code).isNotNull(), F.col(mentions)).otherwise(0))
    return concepts.groupBy(category).agg(F.count("*").alias("concepts"), F.sum(mentions).alias("mentions"), F.coalesce(100.0 * F.try_divide(coded, F.sum(mentions)), F.lit(0.0)).alias("coded_pct"))


def coverage(items: DataFrame, case: str, served: Column) -> DataFrame:
    """One row: items, served, rate, and cases served wholly or in part."""
    by = items.groupBy(case).agg(F.bool_and(served).alias("all"), F.bool_or(served).alias("some"), F.count("*").alias("n"), F.count_if(served).alias("s"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("s"), F.lit(0)).alias("served"), F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("rate"), F.count_if("all").alias("cases_full"), F.count_if(F.col("some") & ~F.col("all")).alias("cases_partial")
    )


def census(donors: DataFrame, required: DataFrame, category: str, least: int) -> DataFrame:
    """Servable donors of every required category, and whether there are enough."""
    n = donors.groupBy(category).agg(F.count("*").alias("donors"))
    return required.join(n, category, "left").withColumn("donors", F.coalesce("donors", F.lit(0))).withColumn("enough", F.col("donors") >= least)


def episode_summary(records: DataFrame) -> DataFrame:
    """Verb counts over all records, from each record's map."""
    return records.select(F.explode("actions_by_verb").alias("verb", "n")).groupBy("verb").agg(F.sum("n").alias("n"))


def episode_report(records: DataFrame, means: dict[str, int], sums: list[str], flags: dict[str, Column], outcome: str = "outcome", verbs: str = "actions_by_verb") -> DataFrame:
    """(part, name, value): episodes, rounded means, sums, how many episodes meet each condition, outcomes and verbs.

    One scan: every record gives a row a figure, which are added up before they
    are shuffled. A missing number counts as 0, since a mean is over all episodes.
    """
    figure = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    fixed = [figure("episodes", F.lit("all"), F.lit(1)), figure("outcome", F.col(outcome), F.lit(1))]
    fixed += [figure("mean", F.lit(m), F.col(m)) for m in means] + [figure("sum", F.lit(s), F.col(s)) for s in sums] + [figure("count", F.lit(n), c.cast("int")) for n, c in flags.items()]
    used = F.transform(F.map_entries(F.coalesce(F.col(verbs), F.create_map().cast("map<string,bigint>"))), lambda e: figure("verb", e["key"], e["value"]))
    found = records.select(F.inline(F.concat(F.array(*fixed), used))).groupBy("part", "name").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
    digits = F.coalesce(F.create_map(*(F.lit(x) for m in means.items() for x in m))[F.col("name")], F.lit(0)) if means else F.lit(0)
    scale = F.pow(F.lit(10.0), digits)
    return found.select("part", "name", F.when(F.col("part") == "mean", F.round(F.col("mean") * scale) / scale).otherwise(F.col("total")).alias("value"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A table of a small aggregate; more rows than the limit raise an error."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])

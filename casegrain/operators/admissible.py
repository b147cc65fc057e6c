"""Whether an action is admissible, for actions that were recorded and are checked again.

An action is a row with its verb, payload and items, and the counters and sets
of the episode before it. Checks are ordered; the first that fails names the
fault. Everything is a column, so a table of actions is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strings, text
from .outcomes import first_error, names_no_diagnosis

# fixed values: the verbs of an action, in the order of an episode
ASK, BEGIN, EXAMINE, ORDER, CONSULT, SEARCH, FINAL, DEFER = "ask", "begin_workup", "physical_examination", "order_tests", "consult_specialist", "search", "final_diagnosis", "defer_to_human"


@dataclass(frozen=True)
class Rules:
    """What a run allows, and its menus."""

    max_asks: int = 10
    min_asks: int = 1
    min_workup: int = 1
    max_items: int = 3
    max_searches: int = 3
    allow_defer: bool = True
    allow_history_final: bool = False
    search: bool = True
    lenient: bool = False
    slots_echo: bool = True
    overlap: float = 0.5
    examinations: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    slot_phrases: tuple[str, ...] = ()
    exam_prefix: str = "Physical Examination/"


def item_key(verb: Column, item: Column, rules: Rules) -> Column:
    """What an item is remembered by: an examination is the same under either verb."""
    low, prefix = F.lower(item), rules.exam_prefix.lower()
    return F.when(verb == EXAMINE, F.concat(F.lit("exam:"), low)).when(low.startswith(prefix), F.concat(F.lit("exam:"), F.substring(low, F.lit(len(prefix) + 1), F.length(low)))).otherwise(F.concat(F.lit("test:"), low))


def first_fault(rules: Rules) -> Column:
    """The first fault of an action, or null.

    Reads verb, payload, items, dropped, phase ('history' or another), asks_used,
    workup_used, searches_used, must_end, overlap (with the questions before),
    used (item keys), pending (departments with studies to read) and searched
    (queries in lower case). Nulls count as nothing asked, used or given.
    """
    verb, payload, history = F.col("verb"), text("payload"), F.col("phase") == "history"
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    items, must_end = each("items"), F.coalesce(F.col("must_end"), F.lit(False))
    listed = verb.isin(EXAMINE, ORDER)
    known = strings([i.lower() for i in rules.examinations]), strings([*(t.lower() for t in rules.tests), *(f"{rules.exam_prefix}{i}".lower() for i in rules.examinations)])
    unknown = F.exists(items, lambda x: ~F.array_contains(F.when(verb == EXAMINE, known[0]).otherwise(known[1]), F.lower(x)))
    again = F.exists(items, lambda x: F.array_contains(each("used"), item_key(verb, x, rules)))
    words = F.trim(F.regexp_replace(F.lower(payload), "[^a-z]+", " "))
    slot = payload.rlike(r"[\[\]]")
    for phrase in rules.slot_phrases:
        slot = slot | F.contains(words, F.lit(phrase))
    department = F.lower(F.trim(payload))
    terminal = verb.isin(FINAL, DEFER) if rules.allow_defer else verb == FINAL
    return first_error(
        (listed & (F.size(each("dropped")) > 0) & F.lit(not rules.lenient), "unknown_category"),
        ((verb == DEFER) & F.lit(not rules.allow_defer), "defer_unavailable"),
        ((verb == DEFER) & history, "defer_in_history"),
        ((verb == FINAL) & history & F.lit(not rules.allow_history_final), "final_in_history"),
        ((verb == DEFER) & slot, "defer_slot_echoed"),
        ((verb == FINAL) & F.contains(payload, F.lit("|")), "several_diagnoses"),
        ((verb == FINAL) & payload.rlike(r"[\[\]]"), "brackets"),
        ((verb == FINAL) & ~must_end & ~history & (count("workup_used") < rules.min_workup), "workup_too_short"),
        (must_end & ~terminal, "must_end"),
        ((verb == ASK) & ~history, "interview_over"),
        ((verb == ASK) & (count("asks_used") >= rules.max_asks), "no_questions_left"),
        ((verb == ASK) & F.trim(payload).rlike(r"^\[.*\]$") & F.lit(rules.slots_echo), "ask_slot_echoed"),
        ((verb == ASK) & (F.coalesce(F.col("overlap"), F.lit(0.0)) >= rules.overlap) & F.lit(not rules.lenient), "question_repeated"),
        (history & ~verb.isin(ASK, DEFER) & (count("asks_used") < rules.min_asks), "history_too_thin"),
        ((verb == FINAL) & names_no_diagnosis(payload), "no_diagnosis"),
        ((verb == BEGIN) & ~history, "workup_begun"),
        (listed & (F.size(items) == 0), "no_items"),
        (listed & unknown, "unknown_items"),
        (listed & (F.size(items) > rules.max_items), "too_many_items"),
        (listed & again, "items_repeated"),
        ((verb == CONSULT) & ~department.isin(*rules.departments), "unknown_department"),
        ((verb == CONSULT) & ~F.array_contains(each("pending"), department), "nothing_pending"),
        ((verb == SEARCH) & F.lit(not rules.search), "search_unavailable"),
        ((verb == SEARCH) & (count("searches_used") >= rules.max_searches), "no_searches_left"),
        ((verb == SEARCH) & F.array_contains(each("searched"), F.lower(payload)), "search_repeated"),
    )


def checked(actions: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``fault`` and, for lists under lenient rules, ``kept`` and ``left_out``.

    A lenient list keeps the items not used before, each once, up to the cap;
    left out are (item, why) of repeats, of those beyond the cap and of what was dropped unresolved.
    """
    out = actions.withColumn("fault", first_fault(rules))
    if not rules.lenient:
        return out
    each = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    seen = lambda x: F.array_contains(each("used"), item_key(F.col("verb"), x, rules))
    fresh = F.array_distinct(F.filter(each("items"), lambda x: ~seen(x)))
    why = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("item"), F.lit(w).alias("why")))
    left = F.concat(why(F.filter(each("items"), seen), "used"), why(F.slice(fresh, rules.max_items + 1, F.greatest(F.size(fresh), F.lit(1))), "cap"), why(each("dropped"), "unknown"))
    listed = F.col("verb").isin(EXAMINE, ORDER)
    return out.withColumn("kept", F.when(listed, F.slice(fresh, 1, rules.max_items))).withColumn("left_out", F.when(listed, left))

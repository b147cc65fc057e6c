"""Plans of task visits, chunk by chunk.

A chunk's visits are dealt to kinds by largest remainder, a share of them to
retired tasks (replay), and the kinds are shuffled over the chunk's steps. A
step draws each kind's need from the open tasks - not drawn in this step, of no
case that was, under the visit cap with what the chunk has planned - and fills
what falls short from all kinds.

Where the draws come from is a parameter. ``Seeded`` draws from a pool in
memory with Python's generator, seeded by SHA-1 of the draw's name. ``Listed``
takes candidate lists that Spark has drawn from a pool of any size.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .curriculum import Schedule, admitted, draw, quotas, rank_weights
from .joins import phase_bounds

KINDS = ("answer", "corrupt", "ook")
REPLAY = "replay"


def hint(*parts) -> int:
    """The first eight bytes of a SHA-1 over the parts."""
    return int.from_bytes(hashlib.sha1("|".join(map(str, parts)).encode()).digest()[:8], "big")


@dataclass(frozen=True)
class Ramp:
    """A value that moves evenly from start to end over a fraction of all steps."""

    start: float
    end: float
    fraction: float

    def at(self, step: int, total: int) -> float:
        return self.start + (self.end - self.start) * min(1.0, step / max(1.0, total * self.fraction))


@dataclass(frozen=True)
class Course:
    """A schedule with all that a plan depends on besides the tasks' state."""

    schedule: Schedule
    total_steps: int
    seed: int
    ook_share: float = 0.15
    corrupt: Ramp = Ramp(0.1, 0.25, 0.5)
    ook_reward: Ramp = Ramp(0.3, 0.4, 0.5)
    replay: float = 0.05
    workup_width: int = 2
    asks_width: int = 1
    mastery_bar: float = 0.7
    frontier_share: float = 0.8
    kinds: tuple[str, ...] = KINDS
    fixed_shares: dict[str, float] = field(default_factory=dict)

    def phase(self, step: int) -> int:
        bounds = phase_bounds(self.schedule.fractions, self.schedule.chunk_steps, self.total_steps)
        return next((i for i, (a, b) in enumerate(bounds) if a <= step < b), len(bounds) - 1)

    def shares(self, step: int) -> dict[str, float]:
        if self.fixed_shares:
            return self.fixed_shares
        corrupt = self.corrupt.at(step, self.total_steps)
        return {"ook": self.ook_share, "corrupt": round(corrupt, 4), "answer": round(1.0 - self.ook_share - corrupt, 4)}

    def budgets(self, t: dict, step: int, caps: dict) -> dict:
        """The visit's jittered caps: below the phase's by a width at most, never below what the task needs."""
        rng = random.Random(hint(self.seed, "jit", t["case"], t["kind"], step))
        needs = (2, 0) if t["kind"] == "ook" else (t["need_workup"], t["need_searches"])
        fewest_asks = max(1, caps["max_asks"] - self.asks_width)
        fewest_turns = min(caps["max_workup_turns"], max(sum(needs), 2, caps["max_workup_turns"] - self.workup_width))
        asks = rng.randint(fewest_asks, caps["max_asks"])
        return {"max_asks": asks, "max_workup_turns": rng.randint(fewest_turns, caps["max_workup_turns"]), "max_searches": caps["max_searches"], "search_enabled": bool(caps.get("search_enabled", caps["max_searches"] > 0))}

    def visit(self, t: dict, step: int, replay: bool, caps: dict) -> dict:
        corrupt = t["kind"] == "corrupt"
        return {
            "step": step, "task": t["task"], "case": t["case"], "kind": t["kind"], "replay": replay, **self.budgets(t, step, caps),
            "corrupt_rate": float(corrupt), "corrupt_seed": f"c{hint(self.seed, 'cseed', t['case'], step):016x}" if corrupt else "0",
            "r_ook": round(self.ook_reward.at(step, self.total_steps), 4), "difficulty": t.get("difficulty") or "",
        }


VISIT = (
    "step int, task string, case string, kind string, replay boolean, max_asks int, max_workup_turns int, max_searches int, "
    "search_enabled boolean, corrupt_rate double, corrupt_seed string, r_ook double, difficulty string"
)


def priorities(tasks: list[dict], step: int, beta: float, rho: float) -> dict[str, float]:
    """Rank by spread to a power, mixed with the share of staleness; an unvisited task's spread is its prior's."""
    spread = lambda t: t["ema_std"] if t["ema_std"] is not None else math.sqrt(t["m0"] * (1 - t["m0"]))
    ranked = sorted(tasks, key=lambda t: (-spread(t), t["task"]))
    power = {t["task"]: (k + 1) ** (-1.0 / beta) for k, t in enumerate(ranked)}
    stale = {t["task"]: float(step - t["last_visit"]) for t in tasks}
    powers, stales = sum(power.values()) or 1.0, sum(stale.values()) or 1.0
    return {n: (1 - rho) * power[n] / powers + rho * stale[n] / stales for n in power}


class Seeded:
    """Draws from tasks in memory."""

    def __init__(self, course: Course, chunk: int, live: list[dict], retired: list[dict]):
        self.course, self.chunk, self.live, self.retired = course, chunk, live, sorted(retired, key=lambda t: t["task"])

    def __call__(self, i: int, step: int, pool: str | None, k: int, is_open: Callable) -> list[dict]:
        p = self.course.schedule.sampler
        rng = random.Random(hint(self.course.seed, *(("topup", self.chunk, i) if pool is None else ("draw", self.chunk, i, pool))))
        if pool == REPLAY:
            left, out = [t for t in self.retired if is_open(t)], []
            while left and len(out) < k:
                out.append(left[rng.randrange(len(left))])
                left = [t for t in left if t["case"] != out[-1]["case"]]
            return out
        out: list[dict] = []
        while len(out) < k:
            cases = {t["case"] for t in out}
            some = {t["task"]: t for t in self.live if is_open(t) and t["case"] not in cases and pool in (None, t["kind"])}
            drawn = draw(rng, priorities(list(some.values()), step, p.beta_r, p.rho), k - len(out), p.eps_uniform, p.eps_floor)
            fresh = len(out)
            for name in drawn:
                if some[name]["case"] not in cases:
                    cases.add(some[name]["case"])
                    out.append(some[name])
            if pool is not None or len(out) == fresh:  # a kind draws once; only the top-up goes on
                break
        return out


class Listed:
    """Draws that Spark has made: for each (step, pool), open tasks in uniform and in weighted order."""

    def __init__(self, course: Course, uniform: dict, weighted: dict):
        self.course, self.uniform, self.weighted = course, uniform, weighted

    def __call__(self, i: int, step: int, pool: str | None, k: int, is_open: Callable) -> list[dict]:
        p = self.course.schedule.sampler
        free = k if pool == REPLAY else int(round(p.eps_uniform * k)) or int(p.eps_floor and p.eps_uniform > 0 and k > 0)
        out: list[dict] = []
        for rows, n in ((self.uniform.get((step, pool), []), free), (self.weighted.get((step, pool), []), k)):
            for t in rows:
                if len(out) < n and is_open(t) and t["case"] not in {x["case"] for x in out}:
                    out.append(t)
        return out


def plan(course: Course, chunk: int, n_live: dict[str, int], n_retired: int, mastered: float, draws) -> tuple[dict, list[dict]]:
    """(header, visits) of a chunk, from the numbers of admitted tasks by kind and of retired ones."""
    s = course.schedule
    start, n = chunk * s.chunk_steps, s.chunk_steps * s.tasks_per_step
    phase = course.phase(start)
    caps, shares, cap = s.phases[phase], course.shares(start), s.sampler.max_visits
    n_replay = min(int(round(course.replay * n)), n_retired)
    with_tasks = {k: v for k, v in shares.items() if n_live.get(k)}
    counts = quotas(n - n_replay, with_tasks) if with_tasks else {}
    deck = [k for k in course.kinds for _ in range(counts.get(k, 0))] + [REPLAY] * n_replay
    random.Random(hint(course.seed, "shuffle", chunk)).shuffle(deck)
    visits: list[dict] = []
    planned: Counter[str] = Counter()
    short = topped = 0
    for i in range(s.chunk_steps):
        step, tasks, cases = start + i, set(), set()

        def is_open(t: dict) -> bool:
            return t["task"] not in tasks and t["case"] not in cases and (cap <= 0 or t["visits"] + planned[t["task"]] < cap)  # noqa: B023

        def take(found: list[dict], replay: bool) -> int:
            for t in found:
                tasks.add(t["task"])  # noqa: B023
                cases.add(t["case"])  # noqa: B023
                planned[t["task"]] += 1
                visits.append(course.visit(t, step, replay, caps))  # noqa: B023
            return len(found)

        need = Counter(deck[i * s.tasks_per_step : (i + 1) * s.tasks_per_step])
        missing = sum(need[pool] - take(draws(i, step, pool, need[pool], is_open), pool == REPLAY) for pool in (*course.kinds, REPLAY) if need[pool])
        if missing:
            short += missing
            topped += take(draws(i, step, None, missing, is_open), False)
    header = {
        "chunk": chunk, "phase": phase + 1, "steps": [start, start + s.chunk_steps], "caps": caps, "quotas": shares, "r_ook": round(course.ook_reward.at(start, course.total_steps), 4),
        "admitted": sum(n_live.values()), "replay": n_replay, "short": short, "topup": topped, "max_visits": cap,
        "quota_deviation": {k: round(counts.get(k, 0) / max(1, n - n_replay) - v, 4) for k, v in shares.items()},
        "frac_mastered": round(mastered, 4), "would_advance": mastered >= course.frontier_share,
    }
    return header, visits


def plan_pool(course: Course, chunk: int, tasks: list[dict]) -> tuple[dict, list[dict]]:
    """``plan`` of tasks in memory: dicts of task, case, kind, horizon, visits, last_visit, ema_std, m0, mastery, retired, shelved and needs."""
    limit, cap = course.phase(chunk * course.schedule.chunk_steps) + 1, course.schedule.sampler.max_visits
    live = [t for t in tasks if t["horizon"] <= limit and not t["retired"] and not t["shelved"] and (cap <= 0 or t["visits"] < cap)]
    retired = [t for t in tasks if t["retired"] and t["horizon"] <= limit]
    mastered = sum(t["mastery"] >= course.mastery_bar for t in live) / len(live) if live else 0.0
    return plan(course, chunk, Counter(t["kind"] for t in live), len(retired), mastered, Seeded(course, chunk, live, retired))


def candidates(tasks: DataFrame, course: Course, chunk: int) -> DataFrame:
    """The first open tasks of each (step, pool) in uniform and in weighted order, with one task a case.

    ``pool`` is a kind, replay, or null for all live tasks; ``by`` is uniform or
    weighted. Weighted order is by log(u) / w with u from a hash: the law of
    drawing one by one by weight. Tasks for all pools weigh as in their kind. As
    a step uses no more cases, and a chunk caps no more tasks, than the lists are
    long, what they leave out could not be drawn; so what comes back is bounded
    by the chunk, however many tasks there are.
    """
    s = course.schedule
    steps = list(range(chunk * s.chunk_steps, (chunk + 1) * s.chunk_steps))
    k = s.tasks_per_step * (1 + (s.chunk_steps if s.sampler.max_visits > 0 else 0))
    limit = course.phase(steps[0]) + 1
    spread = tasks.withColumn("spread", F.coalesce("ema_std", F.sqrt(F.col("m0") * (1 - F.col("m0")))))
    live = rank_weights(admitted(spread, limit, s.sampler.max_visits).withColumn("none", F.lit(0)), "kind", "spread", "task", "none", s.sampler.beta_r, 0.0)
    by_kind = Window.partitionBy("kind")
    live = live.withColumn("n", F.count("*").over(by_kind)).withColumn("seen", F.sum("last_visit").over(by_kind)).withColumn("again", F.lit(False))
    retired = tasks.where((F.col("horizon") <= limit) & F.col("retired")).withColumn("again", F.lit(True))
    # what a visit and the order need; a case's tasks meet before each becomes a row a list
    narrow = ["task", "case", "kind", "visits", "last_visit", "need_workup", "need_searches", "difficulty", "again"]
    rows = live.select(*narrow, "weight", "n", "seen").unionByName(retired.select(narrow), allowMissingColumns=True).repartition("case")
    # a fixed value a (step, pool, by); null is all live tasks, and kinds that the course has not are drawn from no other list
    each = lambda pools, ways: F.array(*(F.struct(F.lit(x).alias("step"), p.alias("pool"), F.lit(w).alias("by")) for x in steps for p in pools for w in ways))
    every, ways = F.lit(None).cast("string"), ("uniform", "weighted")
    lists = F.when(F.col("again"), each((F.lit(REPLAY),), ("uniform",))).when(F.col("kind").isin(*course.kinds), each((F.col("kind"), every), ways)).otherwise(each((every,), ways))
    rows = rows.withColumn("e", F.explode(lists)).select("*", "e.*").drop("e")
    stale = F.try_divide(F.col("step") - F.col("last_visit"), F.col("step") * F.col("n") - F.col("seen"))
    weight = (1 - s.sampler.rho) * F.col("weight") + s.sampler.rho * F.coalesce(stale, F.lit(0.0))
    rows = rows.withColumn("weight", F.when(F.col("again"), 0.0).otherwise(weight)).drop("n", "seen", "again")
    u = (F.pmod(F.xxhash64("task", F.lit(course.seed), "step", F.coalesce(F.concat(F.lit("pool "), "pool"), F.lit("all")), "by"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("u", u).withColumn("key", F.when(F.col("by") == "uniform", 0.0).when(F.col("weight") > 0, F.log("u") / F.col("weight")))
    # tasks without weight come last and evenly, as in ``draw``
    order = [F.desc_nulls_last("key"), F.desc("u"), F.col("task")]
    own = rows.withColumn("first", F.row_number().over(Window.partitionBy("step", "pool", "by", "case").orderBy(*order))).where("first = 1")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("step", "pool", "by").orderBy(*order))).where(F.col("place") <= k).drop("first", "u", "key")


def plan_table(course: Course, chunk: int, tasks: DataFrame) -> tuple[dict, list[dict]]:
    """``plan`` of a table of tasks of any size: the same law as ``plan_pool``, with other draws."""
    s = course.schedule
    limit = course.phase(chunk * s.chunk_steps) + 1
    tasks = stage(tasks, "tasks")  # read three times
    live = admitted(tasks, limit, s.sampler.max_visits)
    counts = {r.kind: (r.n, r.mastered) for r in live.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("mastery") >= course.mastery_bar).alias("mastered")).collect()}
    n_live = {k: n for k, (n, _) in counts.items()}
    n_retired = tasks.where((F.col("horizon") <= limit) & F.col("retired")).count()
    lists: dict[str, dict] = {"uniform": {}, "weighted": {}}
    for r in candidates(tasks, course, chunk).orderBy("place").collect():
        lists[r.by].setdefault((r.step, r.pool), []).append(r.asDict())
    mastered = sum(m for _, m in counts.values()) / sum(n_live.values()) if n_live else 0.0
    return plan(course, chunk, n_live, n_retired, mastered, Listed(course, **lists))

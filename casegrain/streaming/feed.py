"""The feed of finished episodes as a stream, folded into task state.

State per task lives in the state store, so a stream keeps nothing on the
driver and its checkpoint is the offset. The order that matters is the step,
not the arrival: a batch's visits are folded in step order, and a step seen
before changes nothing, however late or often it comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.curriculum import STATE, Sampler, _row, fold_visits, new_state
from ..sources.staging import shared_dir  # noqa: F401

FEED = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_feed(spark: SparkSession, path: str, schema: str = FEED, files: int = 1) -> DataFrame:
    """New files of the feed, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fold_stream(rows: DataFrame, p: Sampler = Sampler(), prior: float = 0.6) -> DataFrame:
    """State of every task a batch touches, from rows (task, step, share).

    A step's rows must come in one batch, as the feed writes a finished group.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else new_state(p.nu, prior)
        now["window"] = [tuple(x) for x in now["window"]]
        shares: dict[int, list[float]] = {}
        for part in parts:
            for step, share in zip(part["step"], part["share"]):
                shares.setdefault(int(step), []).append(float(share))
        visits = []
        for step, x in shares.items():
            mean = sum(x) / len(x)
            visits.append((step, mean, (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5, len(x), sum(v >= p.success_bar for v in x)))
        now = fold_visits(now, visits, p)
        state.update((json.dumps(now),))
        yield pd.DataFrame([_row(key[0], now)])

    return rows.groupBy("task").applyInPandasWithState(update, STATE, "state string", "update", GroupStateTimeout.NoTimeout)


def halt_when(counts: DataFrame, flagged_share: float = 0.02) -> None:
    """Raise if a step fell back at all or was flagged too often; for use in foreachBatch."""
    bad = counts.groupBy("step").agg(F.count_if("fallback").alias("fallbacks"), (F.count_if("flagged") / F.count("*")).alias("share")).where((F.col("fallbacks") > 0) | (F.col("share") > flagged_share)).limit(1).collect()
    if bad:
        raise RuntimeError(f"step {bad[0]['step']} must be looked at: {bad[0].asDict()}")


def drop_aborted(rows: DataFrame, events: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of trajectories without an abort event; too many aborts in one turn raise an error."""
    if events.groupBy(key, "turn").count().where(F.col("count") > most).limit(1).count():
        raise RuntimeError(f"more than {most} aborts in one turn")
    return rows.join(events.select(key).distinct(), key, "left_anti")


def served(keys: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(every key's block, new blocks to append): misses are computed once each, fallbacks never kept."""
    wanted = keys.select(key).distinct()
    missing = wanted.join(cache, key, "left_anti")
    fresh = compute(missing)
    keep = fresh.where("not fallback")
    every = cache.join(wanted, key, "left_semi").withColumn("source", F.lit("cache")).unionByName(fresh.withColumn("source", F.when(F.col("fallback"), "fallback").otherwise("computed")).drop("fallback"), allowMissingColumns=True)
    return keys.join(every, key, "left"), keep.drop("fallback")

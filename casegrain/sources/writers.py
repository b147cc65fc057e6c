"""Writers that publish a table only when it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace(df: DataFrame, path: str, expect: int | None = None) -> int:
    """Write beside ``path``, check the row count, then rename over it.

    ``df`` may read ``path``: nothing there changes before the new table is whole.
    No store renames a folder over another, so there is a moment without a table
    at ``path``; whoever finds it so, this function first of all, has the old
    one moved back by ``recover``.
    """
    spark = df.sparkSession
    recover(spark, path)
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(fresh)
    n = spark.read.schema(df.schema).parquet(fresh).count()
    if expect is not None and n != expect:
        raise ValueError(f"{n} rows were written, {expect} expected")
    jvm = spark.sparkContext._jvm
    p = [jvm.org.apache.hadoop.fs.Path(x) for x in (path, fresh, old)]
    fs = p[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p[2], True)
    if fs.exists(p[0]) and not fs.rename(p[0], p[2]):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(p[1], p[0]):
        recover(spark, path)
        raise OSError(f"{fresh} could not be moved to {path}")
    fs.delete(p[2], True)
    return n


def recover(spark: SparkSession, path: str) -> bool:
    """Move the old table back if a publication stopped before the new one was in place; whether it did."""
    jvm = spark.sparkContext._jvm
    here, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(here) and fs.exists(old) and fs.rename(old, here)


def small_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One headed CSV file, for outputs of report size."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def merged_blocks(records: DataFrame, blocks: DataFrame, key: str, least: int) -> DataFrame:
    """Records with their panel block; a panel of too few graders loses its fused reward."""
    thin = F.col("graders") < least
    both = records.join(blocks, key, "left")
    return both.withColumn("fused_reward", F.when(F.coalesce(thin, F.lit(True)), None).otherwise(F.col("fused_reward")))


def backfill(records: DataFrame, gold: DataFrame, key: str, path: str, score) -> dict[str, int]:
    """Score every record that has a gold name, pass the others through, and publish."""
    joined = records.join(gold, key, "left").withColumn("score", F.when(F.col("gold").isNotNull(), score))
    n = replace(joined, path, records.count())
    scored = joined.where("score is not null").count()
    return {"records": n, "scored": scored, "unmatched": joined.where("gold is null").count()}

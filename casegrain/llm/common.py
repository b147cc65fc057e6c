"""Helpers the training-data operators share.

``stage`` is the one way these operators cut lineage: a Parquet table below
``spark.checkpoint.dir``, which every executor and the driver see, so a lost
executor costs a re-read and never a recomputation of the plan above it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one Python step holds at a time; a longer document is its own block.
BLOCK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Without one the session's own is taken, and on one machine a new local
    folder; a cluster's executors would not see that, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casegrain-"))
    return jsc.getCheckpointDir().get()


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}") not in taken)


def row_name(doc_id, sha):
    """What names a row by its doc_id, null or not, and the digest of its text."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("-")), F.lit(" "), sha), 256)


def text_sha():
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


#: Keys with more than one in so many rows are hot, and at most so many are.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key, ``count`` its number of rows).

    The keys that hold more than a thousandth of the rows, a thousand at most, are
    broadcast, so no task holds a hot key's rows; the others are joined as usual.
    Keys aren't null, each key of ``rows`` is in ``facts``, and ``facts`` is joined without ``count``.
    """
    total = F.lit(facts.agg(F.sum(count)).first()[0] or 0)
    is_hot = F.col(count) * HOT_SHARE > total
    hot, cold = facts.where(is_hot).drop(count), facts.where(~is_hot).drop(count)
    few = rows.join(F.broadcast(hot), keys)
    return few.unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/casegrain-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Free memory goes back to the system, which the allocators would keep: workers that live on share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def sized_slices(batches, column: str, limit: int = BLOCK_BYTES):
    """Record batches cut so that ``column`` holds about ``limit`` bytes in each; what a slice took is given back after it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            give_back()
            start = stop


def split_words(texts: pa.Array, as_list: bool = True) -> tuple[np.ndarray, np.ndarray, list[str] | pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text as (codes, offsets, vocabulary).

    ``codes[offsets[i]:offsets[i + 1]]`` are text i's words in order. A null
    text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    kept = np.asarray(real.to_numpy(zero_copy_only=False), dtype=bool)
    ends = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    coded = flat.filter(real).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, ends[bounds], coded.dictionary.to_pylist() if as_list else coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` of every i, concatenated."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths) + np.arange(total)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for every i; 0 for an empty run."""
    ends = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values)))
    return ends[offsets[1:]] - ends[offsets[:-1]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits of a product hash depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

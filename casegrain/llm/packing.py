"""Packing into optimal length buckets.

Documents longer than the context are cut into pieces. Dynamic programming
over the global histogram of piece lengths chooses the bucket lengths that
waste the least padding. Pieces of one bucket form batches of at most a token
budget; a bucket's pieces are dealt to groups of bounded size first, so no
task orders a whole bucket and each group leaves at most one batch unfilled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, stage, whole_text
from .token_counts import count_tokens

CONTEXT = 2048
BUCKETS = 8
BUDGET = 16_384
#: Pieces that are ordered together.
GROUP = 4096


def word_count():
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text: the measure of length without a tokenizer."""
    return F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def choose_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` ascending lengths with the least total padding.

    Each length goes to the least bucket that holds it. Of equally good
    choices the one with fewer, then with shorter, buckets is taken.
    """
    lengths = sorted(x for x, n in histogram.items() if n)
    if not lengths:
        return []
    size, count = np.array(lengths, dtype=float), np.array([histogram[x] for x in lengths], dtype=float)
    n_before = np.concatenate(([0.0], np.cumsum(count)))
    w_before = np.concatenate(([0.0], np.cumsum(count * size)))
    best = np.full(len(lengths) + 1, np.inf)
    best[0] = 0.0
    backs, finals = [], []
    for _ in range(min(buckets, len(lengths))):
        new, back = np.full(len(best), np.inf), np.zeros(len(best), dtype=np.int64)
        for j in range(1, len(best)):
            # the last bucket holds lengths i .. j - 1, padded to length j - 1
            cost = best[:j] + size[j - 1] * (n_before[j] - n_before[:j]) - (w_before[j] - w_before[:j])
            back[j] = int(np.argmin(cost))
            new[j] = cost[back[j]]
        best = new
        backs.append(back)
        finals.append(best[-1])
    k = int(np.argmin(finals))
    out, j = [], len(lengths)
    while k >= 0:
        out.append(lengths[j - 1])
        j, k = int(backs[k][j]), k - 1
    return out[::-1]


def token_lengths(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n): each row's length in the tokens of a sentencepiece model."""
    return count_tokens(docs, model).select("doc_id", F.col("n_tokens").alias("n"))


def pack(docs: DataFrame, model: str | None = None, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, n_tokens, bucket_length and batch.

    Lengths are tokens of the sentencepiece model at the path ``model``, or words
    without one. A batch holds at most ``budget // bucket_length`` pieces, at least one.
    Null and empty texts are one piece of length 0 in the shortest bucket;
    repeated rows are packed each; extra columns are ignored; an empty table
    gives no piece.
    """
    measured = token_lengths(docs, model) if model else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), word_count().alias("n"))
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.expr(f"(n - 1) div {context}")).cast("bigint"))).alias("piece")
    pieces = measured.select("doc_id", "n", cut).select(
        "doc_id", "piece", (F.col("piece") * context).alias("start"), F.least(F.lit(context).cast("bigint"), F.col("n") - F.col("piece") * context).alias("n_tokens")
    )
    # a number for each row, so that rows of one doc_id are dealt apart
    pieces = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most context + 1 rows
    ends = choose_buckets(histogram, buckets) or [context]
    held = [sum(c for x, c in histogram.items() if a < x <= b) for a, b in zip([-1, *ends[:-1]], ends)]
    which = sum((F.col("n_tokens") > e).cast("int") for e in ends) + 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket"))
    groups = [max(1, -(-h // group)) for h in held]
    dealt = pieces.withColumn("bucket", which).withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "row"), pick(groups)).cast("int"))
    order = Window.partitionBy("bucket", "slot").orderBy("doc_id", "piece", "row")
    placed = dealt.withColumn("at", ((F.row_number().over(order) - 1) / pick([max(1, budget // max(1, e)) for e in ends])).cast("int"))
    return placed.select(
        "doc_id", "piece", "start", "n_tokens", pick(ends).cast("bigint").alias("bucket_length"), F.format_string("%d-%d-%d", "bucket", "slot", "at").alias("batch")
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Toxic passages as maximal scoring segments of token log-odds.

Token log-odds between toxic and clean labelled documents use a Dirichlet
prior in proportion to each token's overall use; tokens whose odds are not
significant count as neutral and cost a little, so the expected score of a
token is negative. One linear scan finds every maximal segment. A segment's
score is calibrated by its extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)),
and a document's evidence is the excess of its significant segments. Tokens
are hashed into a fixed number of buckets, so the table that is broadcast
doesn't grow with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sized_slices, split_words, stage
from .logistic import platt, sigmoid

BITS = 20
#: Labelled documents that the odds are fitted on, those of least xxhash64(doc_id).
SAMPLE = 20_000
#: Parts of the sample whose evidence for the calibration comes from the odds of the others.
FOLDS = 4
#: Standard errors at which a token's log-odds count.
SIGNIFICANT = 3.5
NEUTRAL = -0.25
#: Expected number of equal or better segments in a clean document of this length.
MAX_EXPECTED = 0.05
_EDGES = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum())


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().strip(_EDGES).encode()) & ((1 << BITS) - 1)


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, words = split_words(texts)
    return np.array([bucket(w) for w in words], dtype=np.int64)[codes] if len(codes) else codes, offsets


def segments(scores: np.ndarray, neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) of a token score sequence.

    Linear in the number of tokens that don't have the neutral score: the
    neutral ones between them are one step. A segment starts and ends at a
    positive token and no part of it, nor any longer one, scores more.
    """
    at = np.flatnonzero(scores != neutral)
    found: list[list] = []  # start, end, sum before it, sum after it
    total, last = 0.0, -1
    for i, s in zip(at.tolist(), scores[at].tolist()):
        total += neutral * (i - last - 1)
        last = i
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k = found[k][4] if len(found[k]) > 4 else k - 1
            if k < 0 or found[k][3] >= new[3]:
                new.append(k)
                found.append(new)
                break
            new = [found[k][0], new[1], found[k][2], new[3]]
            del found[k:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


class Model:
    def __init__(self, scores: np.ndarray, lam: float, log_k: float, slope: float = 1.0, offset: float = 0.0):
        self.scores, self.lam, self.log_k, self.slope, self.offset = scores, lam, log_k, slope, offset

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """The significant segments, each with its excess over the extreme-value law."""
        floor = self.log_k + np.log(max(1, len(scores)))
        return [(a, b, e) for a, b, s in segments(scores) if (e := self.lam * s - floor) > -np.log(MAX_EXPECTED)]

    def evidence(self, scores: np.ndarray) -> tuple[float, int]:
        found = self.passages(scores)
        return float(np.log1p(sum(e for _, _, e in found))), len(found)


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Scores a bucket from its counts in toxic and in clean documents."""
    both = toxic + clean
    # as much prior as the smaller class has tokens, dealt out by overall use
    prior = min(toxic.sum(), clean.sum()) * both / max(1.0, both.sum())
    a, b = toxic + prior, clean + prior
    n_a, n_b = a.sum(), b.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(a / (n_a - a)) - np.log(b / (n_b - b))
        z = delta / np.sqrt(1 / a + 1 / b)
    return np.where((both > 0) & (np.abs(z) >= SIGNIFICANT), delta, NEUTRAL)


def karlin(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 at which the mean of exp(lambda * score) over clean tokens is 1."""
    p = weights / weights.sum()
    if not (p @ scores < 0 and (scores[p > 0] > 0).any()):
        return 1.0
    low, high = 1e-6, 1.0
    while p @ np.exp(high * scores) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * scores) < 1 else (low, mid)
    return low


def _counts(batches):
    for batch in sized_slices(batches, "text", 4 << 20):
        buckets, offsets = _buckets(batch.column("text"))
        toxic = np.asarray(batch.column("y").to_numpy(zero_copy_only=False))
        y = np.repeat(toxic, np.diff(offsets))
        keys, n = np.unique(buckets * 2 + y, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 1, pa.int64()), pa.array((keys & 1) * n, pa.int64()), pa.array((1 - (keys & 1)) * n, pa.int64())], names=["bucket", "toxic", "clean"])


def _best(scores_of):
    def run(batches):
        for batch in sized_slices(batches, "text", 4 << 20):
            buckets, offsets = _buckets(batch.column("text"))
            scores = scores_of[buckets]
            best = [max((s for _, _, s in segments(scores[a:b])), default=0.0) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(np.diff(offsets), pa.int64()), pa.array(best, pa.float64())], names=["doc_id", "y", "n", "best"])

    return run


def _score(model: Model):
    def run(batches):
        for batch in sized_slices(batches, "text"):
            buckets, offsets = _buckets(batch.column("text"))
            scores = model.scores[buckets]
            found = [model.evidence(scores[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            x = np.array([f[0] for f in found])
            p = sigmoid(model.slope * x + model.offset)
            out = {"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32)), "evidence": pa.array(x), "n_passages": pa.array([f[1] for f in found], pa.int64())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def held_out():
    """Whether a document is held out from fitting: crc32 of its id as text divides by five."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _odds(texts: DataFrame) -> Model | None:
    """The model of labelled texts before its calibration, or None where they hold words of one class alone."""
    sums = texts.select("text", "y").mapInArrow(_counts, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = sums.column("bucket").to_numpy()
    toxic[at], clean[at] = sums.column("toxic").to_numpy(), sums.column("clean").to_numpy()
    if not toxic.sum() or not clean.sum():
        return None
    scores = log_odds(toxic, clean)
    lam = karlin(scores, clean + min(toxic.sum(), clean.sum()) * (toxic + clean) / (toxic + clean).sum())
    best = texts.select("doc_id", "text", "y").mapInArrow(_best(scores), "doc_id bigint, y int, n bigint, best double").orderBy("doc_id").toArrow()
    y, n, s = (best.column(c).to_numpy().astype(float) for c in ("y", "n", "best"))
    return Model(scores, lam, gumbel_k(lam, n[(y == 0) & (n > 0)], s[(y == 0) & (n > 0)]))


def gumbel_k(lam: float, n: np.ndarray, best: np.ndarray) -> float:
    """log K from clean texts' lengths and best segments.

    The Gumbel law's location: E[exp(-lambda S)] of the best segment is about
    1 / (K n). K is a probability's factor and no more than 1, so where the law
    fits badly (few clean texts, or none) log K is 0, which finds fewer passages.
    """
    return min(0.0, -float(np.mean(np.log(n))) - float(np.log(np.mean(np.exp(-lam * best))))) if len(n) else 0.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, or None where the labels that may be used hold a single class.

    Each of ``FOLDS`` parts of the sample is judged by the odds of the others, and
    the probability is calibrated on that evidence; the odds are then those of all.
    """
    spark = docs.sparkSession
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ).collect()
    if len({r.y for r in ids}) < 2:
        return None
    chosen = spark.createDataFrame(ids, "doc_id bigint, y int")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    # of texts under one doc_id the least, so that the sample is no larger than its ids
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = stage(sampled.withColumn("fold", fold), "toxic-sample")
    model = _odds(texts)
    if model is None:
        return None
    parts = [(k, _odds(texts.where(F.col("fold") != k))) for k in range(FOLDS)]
    if any(other is None for _, other in parts):  # too few labels for folds
        parts = [(None, model)]
    x, y = [], []
    for k, other in parts:
        mine = texts if k is None else texts.where(F.col("fold") == k)
        judged = mine.select("doc_id", "text").mapInArrow(_score(other), _KINDS).select("doc_id", "evidence").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()
        x.append(judged.column("evidence").to_numpy())
        y.append(judged.column("y").to_numpy().astype(float))
    model.slope, model.offset = platt(np.concatenate(x), np.concatenate(y))
    return model


_KINDS = "doc_id bigint, score double, predicted int, evidence double, n_passages bigint"


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence and n_passages.

    The score is the calibrated probability that label ``toxic`` is 1. Null and
    empty texts hold no passage and get the probability of such documents; with
    no usable labels, or of one class, every score is 0. Repeated rows are each
    scored; extra columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(narrow, labels, sample) or Model(np.full(1 << BITS, NEUTRAL), 1.0, 0.0, 0.0, -35.0)
    scored = narrow.mapInArrow(_score(model), _KINDS)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence", "n_passages")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

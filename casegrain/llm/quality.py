"""Quality rules: plain counts, then a hashed n-gram logistic regression.

Words (one and two) and characters (three) are hashed into one table of
weights; a document's score is the mean weight of its word n-grams plus the
mean weight of its character n-grams. The weights are fitted on a bounded
sample of labelled documents, three quarters of it; the other quarter
calibrates probabilities. Every document is scored in Arrow batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, segment_sums, sized_slices, split_words
from .logistic import fit_sparse, platt, sigmoid

BITS = 18
#: Labelled documents that the classifier is fitted on, those of least xxhash64(doc_id).
SAMPLE = 2000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least calibrated probability of good quality at which a document is kept.
KEEP = 0.5
_SYMBOLS = "#*$%&|<>"
_SHIFT = np.uint32(32 - BITS)
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


class Block:
    """Word and character views of some texts at once."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        self.codes, self.offsets, self.words = split_words(self.texts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))

    def follows(self, k: int) -> np.ndarray:
        """Positions whose next k words are in the same text."""
        return np.flatnonzero(self.doc[k:] == self.doc[:-k]) if len(self.doc) > k else np.zeros(0, dtype=np.int64)

    def word_features(self) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.array([zlib.crc32(w.encode()) for w in self.words], dtype=np.uint32)[self.codes] if len(self.codes) else np.zeros(0, np.uint32)
        at = self.follows(1)
        both = hashes[at] * _A + hashes[at + 1] * _B if len(at) else hashes[:0]
        return np.concatenate((self.doc, self.doc[at])), np.concatenate((hashes * _C, both)) >> _SHIFT

    def char_features(self) -> tuple[np.ndarray, np.ndarray]:
        texts = self.texts.to_pylist()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        if len(chars) < 3:
            return doc[:0], chars[:0]
        same = doc[2:] == doc[:-2]
        return doc[:-2][same], ((chars[:-2] * _A + chars[1:-1] * _B + chars[2:] * _C) >> _SHIFT)[same]

    def counts(self) -> dict[str, np.ndarray]:
        n_words = np.diff(self.offsets)
        words = pa.array(self.words, pa.string())
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = sum((pc.count_substring(words, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in _SYMBOLS), np.zeros(len(words), np.int64))
        repeats = np.zeros(len(self.codes), dtype=bool)
        at = self.follows(2)
        if len(at):
            _, pair = np.unique(self.codes[at] * len(self.words) + self.codes[at + 1], return_inverse=True)
            _, triple = np.unique(pair * len(self.words) + self.codes[at + 2], return_inverse=True)
            _, back, times = np.unique(self.doc[at] * (triple.max() + 1) + triple, return_inverse=True, return_counts=True)
            hit = at[times[back] > 1]
            for k in range(3):
                repeats[hit + k] = True
        lines = []
        for text in self.texts.to_pylist():
            real = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            lines.append(len(real) - len(set(real)))
        return {
            "n_words": n_words, "word_chars": segment_sums(lengths[self.codes], self.offsets), "n_symbols": segment_sums(symbols[self.codes], self.offsets),
            "n_dup_lines": np.array(lines, dtype=np.int64), "n_repeat_words": segment_sums(repeats.astype(np.int64), self.offsets),
        }

    def means(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.texts))
        for doc, feature in (self.word_features(), self.char_features()):
            n = np.bincount(doc, minlength=len(out))
            out += np.bincount(doc, weights=weights[feature], minlength=len(out)) / np.maximum(n, 1)
        return out


def _sample_features(batches):
    """Each sampled document's distinct features with their mean shares."""
    for batch in sized_slices(batches, "text", 1 << 20):
        block = Block(batch.column("text"))
        rows, columns, values = [], [], []
        for doc, feature in (block.word_features(), block.char_features()):
            n = np.bincount(doc, minlength=batch.num_rows)
            keys, counts = np.unique(doc.astype(np.int64) << BITS | feature.astype(np.int64), return_counts=True)
            rows.append(keys >> BITS)
            columns.append(keys & ((1 << BITS) - 1))
            values.append(counts / n[rows[-1]])
        rows, columns, values = (np.concatenate(x) for x in (rows, columns, values))
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
        packs = [(columns[o].astype("<u4").tobytes(), values[o].astype("<f4").tobytes()) for o in (order[cuts[i] : cuts[i + 1]] for i in range(batch.num_rows))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([p[0] for p in packs], pa.binary()), pa.array([p[1] for p in packs], pa.binary())],
            names=["doc_id", "y", "columns", "shares"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float] | None:
    """(weights, slope, offset), or None where the labels hold a single class."""
    picked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    ids = picked.collect()
    if len({r.y for r in ids}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, y int")
    # of texts under one doc_id the least, so that the sample is no larger than its ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_sample_features, "doc_id bigint, y int, columns binary, shares binary").orderBy("doc_id").collect()
    if len({r.y for r in rows}) < 2:
        return None
    y = np.array([r.y for r in rows], dtype=float)
    sizes = [len(r["columns"]) // 4 for r in rows]
    at = np.repeat(np.arange(len(rows)), sizes)
    columns = np.frombuffer(b"".join(r["columns"] for r in rows), dtype="<u4").astype(np.int64)
    shares = np.frombuffer(b"".join(r["shares"] for r in rows), dtype="<f4").astype(float)
    hold = np.arange(len(rows)) % 4 == 3
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold[:] = False
    new, used = np.cumsum(~hold) - 1, ~hold[at]
    weights, _ = fit_sparse(new[at[used]], columns[used], shares[used], y[~hold], 1 << BITS)
    z = np.bincount(at, weights=weights[columns] * shares, minlength=len(rows))
    judge = hold if hold.any() else ~hold
    return weights.astype(np.float32), *platt(z[judge], y[judge])


def _judge(block: Block, model) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(counts, whether the base rules fail, probability of good quality)."""
    c = block.counts()
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    return c, failed, np.ones(len(failed)) if model is None else sigmoid(model[1] * block.means(model[0]) + model[2])


def _score(model):
    def run(batches):
        for batch in sized_slices(batches, "text"):
            c, failed, p = _judge(Block(batch.column("text")), model)
            out = {"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in c.items()}
            out |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= KEEP)), "p_good": pa.array(p)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: the counts, base_failed, kept and p_good, its probability of good quality.

    kept is false where base_failed, else whether p_good reaches ``KEEP``; with
    labels of one class or none there is no model and p_good is 1. Null and
    empty texts have no words and fail; repeated rows are each judged; extra
    columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double"
    return narrow.mapInArrow(_score(fit(narrow, labels, sample)), kinds)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the quality rules keep, with all their columns.

    Rows of null and empty texts fail the base rules and go; repeated rows go or
    stay together; without labels of both classes the base rules alone decide;
    an empty table stays empty.
    """
    model = fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)

    def run(batches):
        for batch in sized_slices(batches, "text"):
            _, failed, p = _judge(Block(batch.column("text")), model)
            yield batch.filter(pa.array(~failed & (p >= KEEP)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

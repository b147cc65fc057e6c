"""Benchmark decontamination: BM25 with block-max WAND, then overlap checks.

Test items form an inverted index with BM25 impacts, divided by each item's
score against itself, so one threshold holds for all. Every passage of every
document is a query: passages are two strides long and overlap by one, and a
stride is no shorter than any item of its index; items are indexed by length
class, so that a long one doesn't lengthen the passages of the others.

Upper bounds alone decide what is skipped. For all passages of a batch at once,
the block maxima of a passage's terms are added up for each block of items; in
a block its most common terms are left out of that sum's postings while
together they stay below the threshold, so every block that can reach it has a
posting. Passages with such a block are run by block-max WAND: cursors in item
order, the pivot where the terms' maxima reach the threshold, a skip to the
block's end where its maxima don't, an exact score where they do. So exactly
the items at or above the threshold are retrieved.

Retrieved pairs are verified on five-word shingles of the item (its whole word
sequence if that is shorter) and on its question and answer parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, read_table, sized_slices, split_words, stage

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.5
SHINGLE = 5
SIMILARITY = 0.8
PART_SHINGLE, PART_SIMILARITY = 3, 0.5
ITEMS_PER_BLOCK = 2
#: Block postings that are added up at a time.
POSTINGS = 1 << 20
#: Text whose passages are run at a time.
TEXT_BYTES = 4 << 20
EPSILON = 1e-9
LEAST_STRIDE = 64
#: Item text that one pass over the documents holds; statistics are those of all items in any case.
INDEX_BYTES = 4 << 20


def normal(words: pa.Array) -> pa.Array:
    """Words in lower case, letters and digits alone; an empty text for none."""
    return pc.replace_substring(pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]+", ""), "ß", "ss")


def item_words(text: str | None) -> list[str]:
    words = normal(pa.array(re.findall(r"[^\x20\x09-\x0D]+", text or ""), pa.string()))
    return [w for w in words.to_pylist() if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words before and after its last question mark, or else its last sentence."""
    text = text or ""
    cut = text.rfind("?") + 1
    if not cut or not item_words(text[cut:]) or not item_words(text[:cut]):
        ends = [m.end() for m in re.finditer(r"[.!?\n]+", text) if item_words(text[: m.end()]) and item_words(text[m.end() :])]
        cut = ends[-1] if ends else 0
    if cut:
        return item_words(text[:cut]), item_words(text[cut:])
    words = item_words(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def _shingles(words, width: int) -> set:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


class Statistics:
    """Numbers of items, of their words and of the items that hold each term."""

    def __init__(self, n_items: int, n_words: int, df: dict[str, int]):
        self.n_items, self.mean, self.df = n_items, n_words / max(1, n_items), df

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Statistics:
        words = [w for _, t in items if (w := item_words(t))]
        return cls(len(words), sum(map(len, words)), Counter(x for w in words for x in set(w)))


class Index:
    """Items of one length class. A text under many ids is scored once and counts as many items."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics.of(items)
        owners: dict[str, list[int]] = {}
        for i, t in items:
            owners.setdefault(t, []).append(i)
        kept = [(i, t, w) for t, i in owners.items() if (w := item_words(t))]
        self.ids = [i for i, _, _ in kept]
        self.terms: dict[str, int] = {}
        numbered = [[self.terms.setdefault(x, len(self.terms)) for x in w] for _, _, w in kept]
        self.shingles = [_shingles(w, SHINGLE) for w in numbered]
        self.parts = [[_shingles([self.terms[x] for x in p], PART_SHINGLE) for p in question_and_answer(t)] for _, t, _ in kept]
        self.stride = max([LEAST_STRIDE, *map(len, numbered)])
        self.names = pa.array(list(self.terms), pa.string())
        lengths = np.array([len(w) for w in numbered], dtype=np.int64)
        pairs, n = np.unique(np.array([x for w in numbered for x in w], dtype=np.int64) * max(1, len(kept)) + np.repeat(np.arange(len(kept)), lengths), return_counts=True)
        term, self.item = np.divmod(pairs, max(1, len(kept)))
        df = np.array([statistics.df[t] for t in self.terms], dtype=float)[term]
        idf = np.log(1 + (statistics.n_items - df + 0.5) / (df + 0.5))
        impact = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[self.item] / statistics.mean)) if len(n) else np.zeros(0)
        self.impact = impact / np.bincount(self.item, weights=impact, minlength=len(kept))[self.item]
        self.cuts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self._index_blocks(term)

    def _index_blocks(self, term: np.ndarray) -> None:
        self.n_blocks = max(1, -(-len(self.ids) // ITEMS_PER_BLOCK))
        self.keys, back = np.unique(term * self.n_blocks + self.item // ITEMS_PER_BLOCK, return_inverse=True)
        self.maxima = np.zeros(len(self.keys))
        np.maximum.at(self.maxima, back, self.impact)
        t, block = np.divmod(self.keys, self.n_blocks)
        often = np.bincount(t, minlength=len(self.terms))[t]
        # in each block terms are left out from the most common on, while they can't reach the threshold
        order = np.lexsort((t, -often, block))
        total = np.cumsum(self.maxima[order])
        heads = np.searchsorted(block[order], np.arange(self.n_blocks))
        total -= np.concatenate(([0.0], total))[heads][block[order]]
        out = order[total < THRESHOLD - 2 * EPSILON]
        self.out_total = np.bincount(block[out], weights=self.maxima[out], minlength=self.n_blocks)
        posted = np.ones(len(self.keys), dtype=bool)
        posted[out] = False
        self.left_out = np.sort(out)
        self.posted_block, self.posted_max = block[posted], self.maxima[posted]
        self.posted_cuts = np.searchsorted(t[posted], np.arange(len(self.terms) + 1))
        # what WAND walks, as plain lists
        self.lists = (self.item.tolist(), self.impact.tolist(), self.cuts.tolist())
        self.best = [float(self.impact[a:b].max()) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        self.block_best = dict(zip(self.keys.tolist(), self.maxima.tolist()))

    def _open(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages with a block whose maxima reach the threshold, from distinct (passage, term) pairs in order."""
        n = self.posted_cuts[term + 1] - self.posted_cuts[term]
        at = ragged(self.posted_cuts[term], n)
        pairs, back = np.unique(np.repeat(passage, n) * self.n_blocks + self.posted_block[at], return_inverse=True)
        bound = np.bincount(back, weights=self.posted_max[at], minlength=len(pairs))
        p, block = np.divmod(pairs, self.n_blocks)
        sure = bound >= THRESHOLD - EPSILON
        near = ~sure & (bound + self.out_total[block] >= THRESHOLD - EPSILON)
        sure, p, block, bound = p[sure], p[near], block[near], bound[near]
        if len(p):
            first = np.searchsorted(passage, p)
            n = np.searchsorted(passage, p, side="right") - first
            pair = np.repeat(np.arange(len(p)), n)
            keys = self.keys[self.left_out]
            asked = term[ragged(first, n)] * self.n_blocks + block[pair]
            at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            hit = keys[at] == asked if len(keys) else np.zeros(len(asked), dtype=bool)
            bound += np.bincount(pair[hit], weights=self.maxima[self.left_out[at[hit]]], minlength=len(p))
        return np.unique(np.concatenate((sure, p[bound >= THRESHOLD - EPSILON])))

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) at or above the threshold for a passage of these distinct terms."""
        items, impacts, cuts = self.lists
        least, width, blocks = THRESHOLD - EPSILON, ITEMS_PER_BLOCK, self.n_blocks
        cursors = [[items[cuts[t]], t, cuts[t]] for t in terms]  # current item, term, posting
        found: list[tuple[int, float]] = []

        def move(some, to):
            for c in some:
                if c[0] < to:
                    c[2] = bisect_left(items, to, c[2] + 1, cuts[c[1] + 1])
                    c[0] = items[c[2]] if c[2] < cuts[c[1] + 1] else -1

        while cursors:
            cursors.sort()
            reach, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                reach += self.best[c[1]]
                if reach >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            some, block = cursors[: pivot + 1], item // width
            if sum(self.block_best.get(c[1] * blocks + block, 0.0) for c in some) < least:
                after = (block + 1) * width
                move(some, min(after, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else after)
            elif cursors[0][0] == item:
                score = sum(impacts[c[2]] for c in some)
                if score >= least:
                    found.append((item, score))
                move(some, item + 1)
            else:
                move(some, item)
            if any(c[0] < 0 for c in some):
                cursors = [c for c in cursors if c[0] >= 0]
        return found

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passages, items, scores) at or above the threshold, from distinct (passage, term) pairs in order."""
        found: list[tuple[int, int, float]] = []
        ends = np.cumsum(self.posted_cuts[term + 1] - self.posted_cuts[term])
        lo = 0
        while lo < len(term):
            before = ends[lo - 1] if lo else 0
            # whole passages, one at least
            last = max(lo, int(np.searchsorted(ends, before + POSTINGS, side="right")) - 1)
            hi = int(np.searchsorted(passage, passage[last], side="left" if last + 1 < len(term) and passage[last] > passage[lo] else "right"))
            for p in self._open(passage[lo:hi], term[lo:hi]).tolist():
                a, b = np.searchsorted(passage, (p, p + 1))
                found += [(p, *x) for x in self.wand(term[a:b].tolist())]
            lo = hi
        return tuple(np.array(x, dtype=kind) for x, kind in zip(zip(*found), (np.int64, np.int64, float))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def verify(self, item: int, terms: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, and of its question's and answer's, in a passage."""
        words = terms.tolist()
        whole = self.shingles[item]
        width = len(next(iter(whole)))
        found = [len(whole & {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}) / len(whole)]
        for part in self.parts[item]:
            width = len(next(iter(part))) if part else 0
            found.append(len(part & {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}) / len(part) if part else 1.0)
        return found[0], found[1], found[2]

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item id, score, overlap, question overlap, answer overlap) of verified pairs."""
        codes, offsets, words = split_words(texts, as_list=False)
        plain = normal(words)
        number = pc.fill_null(pc.index_in(plain, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        real = pc.not_equal(plain, "").to_numpy(zero_copy_only=False).astype(bool)[codes]
        ends = np.concatenate(([0], np.cumsum(real)))[offsets]
        terms = number[codes[real]]
        lengths = np.diff(ends)
        strides = np.maximum(1, -(-lengths // self.stride))
        first = np.concatenate(([0], np.cumsum(strides)))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        stride = first[:-1][doc] + (np.arange(len(terms)) - ends[:-1][doc]) // self.stride
        seen = terms >= 0
        # a word is in the passage that starts with its stride and in the one before
        key = stride[seen] * len(self.terms) + terms[seen]
        before = (stride > first[:-1][doc])[seen]
        pairs = np.sort(np.concatenate((key, key[before] - len(self.terms))))
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        best: dict[tuple[int, int], tuple] = {}
        owner = np.repeat(np.arange(len(lengths)), strides)
        for p, item, score in zip(*(x.tolist() for x in self.retrieve(*np.divmod(pairs, max(1, len(self.terms)))))):
            row = int(owner[p])
            a = ends[row] + (p - first[row]) * self.stride
            passage = terms[a : min(a + 2 * self.stride, ends[row + 1])]
            overlap, question, answer = self.verify(item, passage)
            if overlap >= SIMILARITY and question >= PART_SIMILARITY and answer >= PART_SIMILARITY:
                best[row, item] = max(best.get((row, item), ()), (score, overlap, question, answer))
        return [(row, i, *found) for (row, item), found in sorted(best.items()) for i in self.ids[item]]


class Benchmark:
    """Indexes of items by length class: a class holds items of up to 64, 128, 256 ... words."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics.of(items)
        classes: dict[int, list[tuple[int, str]]] = {}
        for i, t in items:
            if n := len(item_words(t)):
                classes.setdefault(max(0, (n - 1) // LEAST_STRIDE).bit_length(), []).append((i, t))
        self.indexes = [Index(some, statistics) for _, some in sorted(classes.items())]

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
        return sorted(f for index in self.indexes for f in index.leaks(texts))


def _term_rows(batches):
    for batch in batches:
        found = [item_words(t) for t in batch.column("text").to_pylist()]
        parts = batch.column("part").to_pylist()
        rows = [(p, x, len(w) if k == 0 else 0) for p, w in zip(parts, found) for k, x in enumerate(sorted(set(w)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], names=["part", "term", "n_words"])


def benchmarks(benchmark: DataFrame, limit: int = INDEX_BYTES):
    """All items, in parts of at most about ``limit`` bytes of text with the statistics of all."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    if n > 1:
        terms = stage(dealt.mapInArrow(_term_rows, "part int, term string, n_words bigint"), "benchmark-terms")
        n_items, n_words = terms.agg(F.count_if(F.col("n_words") > 0), F.sum("n_words")).first()
        df = terms.groupBy("term").agg(F.count("*").alias("df"))
    for k in range(n):
        part = [(r.item_id, r.text) for r in dealt.where(F.col("part") == k).orderBy("item_id", "text").collect()]
        statistics = None
        if n > 1:
            held = df.join(terms.where(F.col("part") == k).select("term").distinct(), "term")
            statistics = Statistics(n_items, n_words, {r.term: r.df for r in held.collect()})  # at most the part's words
        built = Benchmark(part, statistics)
        if built.indexes:
            yield built


_PAIRS = "doc_id bigint, item_id bigint, bm25 double, overlap double, question_overlap double, answer_overlap double"


def _pairs(index: Benchmark):
    def run(batches):
        for batch in sized_slices(batches, "text", TEXT_BYTES):
            found = index.leaks(batch.column("text"))
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            columns = [ids, pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item (id and text) of which the document holds a copy.

    An item of fewer than five words is held where its whole word sequence is.
    Null and empty texts hold none; items that are null or have no word match
    nothing; repeated document rows are each reported, a repeated item once and
    equal texts under many ids under each; extra columns are ignored; with an
    empty table on either side the result is empty.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], _PAIRS)
    for index in benchmarks(benchmark):
        out = out.unionByName(narrow.mapInArrow(_pairs(index), _PAIRS))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no copy of a test item, with all their columns.

    Null and empty texts stay, repeated rows stay or go together; without items
    every row stays; an empty table stays empty.
    """

    def clean(index: Benchmark):
        def run(batches):
            for batch in sized_slices(batches, "text", TEXT_BYTES):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[f[0] for f in index.leaks(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in benchmarks(benchmark):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

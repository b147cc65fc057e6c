"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint is eight positional bytes. Two that differ in at most four bits
differ in at most four bytes, so they share at least four: the guaranteed
minimum. Lists of one positional byte each hold 1/256 of the corpus, and their
pairs grow with its square; so a posting list is kept under the bytes of
``n`` positions, for each choice of n. Any pair that shares four bytes meets in
such a list for n up to four, and n is the least at which a fingerprint meets
``MEETINGS`` others or fewer on average. A list tallies the shared positional
bytes of its pairs, retains those that reach the minimum and verifies their
bits; a pair is retained in the list of its first shared positions alone. A
long list is searched from one fingerprint to all that are not yet linked, so
it returns a spanning forest and a group around one text costs no square. Equal
fingerprints are one entry from the start, so a group of copies, however
large, is one fingerprint here.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hot_join, mix64, read_table, row_name, sized_slices, stage, text_sha
from .components import components

MAX_BITS = 4
MIN_SHARED = 8 - MAX_BITS
#: Others that a fingerprint meets in all lists, if fingerprints were random.
MEETINGS = 128
#: Fingerprints that one packed posting bucket holds on average.
BUCKET = 400_000
#: Posting lists up to this length are compared as shifted columns, longer ones as blocks.
SHORT = 24
BLOCK = 256


class Choices:
    """The choices of ``n`` of the eight positions under which postings are kept."""

    def __init__(self, n: int):
        self.positions = list(combinations(range(8), n))
        self.bytes = [np.uint64(sum(0xFF << (8 * p) for p in c)) for c in self.positions]
        self.masks = [sum(1 << p for p in c) for c in self.positions]
        #: The lowest n set bits of each mask of shared positions; 0 where the tally is below the minimum.
        self.first = np.array([sum(1 << p for p in [p for p in range(8) if m >> p & 1][:n]) if m.bit_count() >= MIN_SHARED else 0 for m in range(256)])


def width_for(n_prints: int) -> int:
    """Positions of a posting key, for so many distinct fingerprints."""
    return next((n for n in range(1, MIN_SHARED) if comb(8, n) * n_prints <= MEETINGS * 256**n), MIN_SHARED)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the text's ``width``-word shingles; 0 without a word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends[: len(words) - width]]
    parts = map(joined.__getitem__, map(slice, starts, map((-1).__add__, ends[width - 1 :])))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in sized_slices(batches, "text"):
            known: dict[str, int] = {}
            values = [known[t] if t in known else known.setdefault(t, fingerprint(t, width)) for t in batch.column("text").to_pylist()]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=[*others, "fp"])

    return run


def _postings(n_buckets: int, choices: Choices):
    """Packed fingerprints for each (choice of positions, hash of their bytes)."""

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            buckets, packs = [], []
            for c, mask in enumerate(choices.bytes):
                part = (mix64(fps & mask) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                    buckets.append(c * n_buckets + int(part[order[lo]]))
                    packs.append(fps[order[lo:hi]].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(packs, pa.binary())], names=["bucket", "fps"])

    return run


def _shared(x: np.ndarray) -> np.ndarray:
    """The mask of shared positions of pairs, from the xor of their fingerprints."""
    shared = np.zeros(x.shape, dtype=np.uint8)
    for p in range(8):
        shared |= ((x >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).astype(np.uint8) << np.uint8(p)
    return shared


def _linked(a: np.ndarray, b: np.ndarray, choices: Choices, choice: int) -> np.ndarray:
    """Pairs that this list retains by the tally of their shared bytes, verified on their bits."""
    x = a ^ b
    kept = choices.first[_shared(x)] == choices.masks[choice]
    kept[kept] = np.bitwise_count(x[kept]) <= MAX_BITS
    return kept


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the list's pairs connect: each fingerprint is reached once."""
    left, out = fps, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for at in range(0, len(front), BLOCK):
                some = front[at : at + BLOCK]
                owner = np.full(len(left), -1, dtype=np.int64)
                for lo in range(0, len(left), 4096):
                    x = some[:, None] ^ left[None, lo : lo + 4096]
                    near = np.bitwise_count(_shared(x)) >= MIN_SHARED
                    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
                    row = near.argmax(axis=0)
                    hit = near[row, np.arange(near.shape[1])]
                    owner[lo : lo + 4096][hit] = row[hit]
                hit = owner >= 0
                if hit.any():
                    out.append((some[owner[hit]], left[hit]))
                    reached.append(left[hit])
                    left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(reached) if reached else front[:0]
    return out


def _match(n_buckets: int, choices: Choices):
    def match(table: pa.Table) -> pa.Table:
        choice = table.column("bucket")[0].as_py() // n_buckets
        fps = np.frombuffer(b"".join(table.column("fps").to_pylist()), dtype="<u8")
        key = fps & choices.bytes[choice]
        order = np.argsort(key, kind="stable")
        fps, key = fps[order], key[order]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(cuts, len(fps)))
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        short = np.repeat(sizes <= SHORT, sizes)
        for d in range(1, SHORT):
            pair = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
            if not len(pair):
                break
            near = _linked(fps[pair], fps[pair + d], choices, choice)
            found.append((fps[pair[near]], fps[pair[near] + d]))
        for k in np.flatnonzero(sizes > SHORT):
            found += _forest(fps[cuts[k] : cuts[k] + sizes[k]])
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return match


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): every document's 64-bit fingerprint, as a signed long."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints(width), "doc_id bigint, fp bigint")


def links(fps: DataFrame, width: int | None = None) -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all near pairs do.

    ``width`` is the number of positions of a posting key, by which no link is lost.
    """
    n_prints = fps.count()
    n_buckets, choices = max(1, -(-n_prints // BUCKET)), Choices(width or width_for(n_prints))
    posted = fps.select("fp").mapInArrow(_postings(n_buckets, choices), "bucket bigint, fps binary")
    return posted.groupBy("bucket").applyInArrow(_match(n_buckets, choices), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id.

    Documents link when their fingerprints differ in at most four bits, and
    component_id is the least doc_id that links reach. Null and empty texts
    have fingerprint zero and are linked like any other; repeated rows share
    their component; extra columns are ignored; an empty table gives none.
    """
    all_fps = stage(fingerprints(docs, width), "fingerprints")
    rooted = _rooted(all_fps)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    owner = hot_join(rooted, least, ["root"], "n").select("fp", "component_id", "rows").withColumnRenamed("rows", "n")
    return hot_join(all_fps, owner, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(all_fps: DataFrame) -> DataFrame:
    """(fp, first, rows, root): each fingerprint's least doc_id, its rows and the fingerprint that names its component."""
    distinct = stage(all_fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct-fingerprints")
    roots = components(links(distinct), "a", "b").select(F.col("node").alias("fp"), "root")
    return stage(distinct.join(roots, "fp", "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")), "rooted")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id, with all its columns.

    A null doc_id comes last, of texts under one doc_id the one of the least
    SHA-256 first, and of equal rows of doc_id and text any one stays. Rows that
    share no more than their doc_id, or have none, all stay. Null and empty texts
    are one group; an empty table stays empty.
    """
    all_fps = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_sha().alias("sha"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(4), "doc_id bigint, sha string, fp bigint"), "fingerprints")
    # the order of structs puts false before true, so a null doc_id last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha"))
    of_print = all_fps.groupBy("fp").agg(least.alias("row"))
    key, own = free_name(docs, "key"), free_name(docs, "own")
    first = of_print.join(_rooted(all_fps), "fp").groupBy("root").agg(F.min("row").alias("row"))
    first = first.select(row_name(F.col("row.doc_id"), F.col("row.sha")).alias(key))
    kept = docs.withColumn(own, row_name(F.col("doc_id"), text_sha())).join(first, F.col(own) == F.col(key), "left_semi")
    return kept.dropDuplicates([own]).drop(own)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))

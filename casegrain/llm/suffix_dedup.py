"""Exact removal of repeated byte strings by distributed deep-shallow suffix sorting.

Every byte that a ``WIDTH``-byte string covers which also starts earlier in the
corpus is removed. Equal strings must meet without moving every suffix, so:

1. Documents equal to an earlier one are found by digest; all their strings
   start earlier, and they are no one else's only source.
2. Each ``WIDTH``-byte window has an anchor, the ``SEED`` bytes in it of the least
   hash (the leftmost of equals); equal windows have equal anchors. Anchors
   that occur once in the corpus belong to windows that don't repeat.
3. The windows of an anchor are one stretch of bytes around it. Stretches of
   repeated anchors meet in a bucket by the anchor's hash, a stretch once a
   batch of documents; further copies in the batch are covered by the first.
4. A bucket sorts what follows the anchors and, reversed, what precedes them:
   multikey order to a shallow depth, then a blind trie for each group that
   still ties. Prefix classes from the LCPs of both orders name the equal
   windows, and all but a class's earliest are covered.

Nothing depends on hashes being free of collisions but the grouping in step 2
and 3; which windows are equal is decided on bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, hot_join, mix64, ragged, read_table, row_name, sized_slices, stage, text_sha
from .token_counts import pack, unpack

WIDTH = 100
SEED = 32
#: Positions of an anchor in a window.
SPAN = WIDTH - SEED
#: Bytes that tie before a group is ordered by a blind trie.
SHALLOW = 16
#: Text bytes that share a message, and for which there is one bucket.
BATCH = 8 << 20
BUCKET = 16 << 20
#: Text bytes whose anchors are computed at a time.
CHUNK = 1 << 20
#: Messages that a batch sends at most; with more buckets, groups of buckets take them and send them on.
GROUPS = 4096
#: Anchors that are sent on together.
REGROUP = 4 << 20
#: Stretch bytes from which a bucket's equal stretches are reduced first, so many messages at a time.
HOT_BYTES = 64 << 20
FAN = 64


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, position, least, most) of the anchors of concatenated texts.

    ``ends`` are the texts' ends. ``most`` and ``least`` say how far before the anchor
    its first and last window start.
    """
    n = len(data) - WIDTH + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h, width = data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15), 1
    for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        h = h[:-width] * np.uint64(odd) + h[width:]
        width *= 2
    h = mix64(h)
    value, place, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < SPAN + 1:
        step = min(have, SPAN + 1 - have)
        left = value[:-step] <= value[step:]
        value, place, have = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:]), have + step
    starts = np.arange(n)
    owner_end = ends[np.searchsorted(ends, starts, side="right")]
    real = starts + WIDTH <= owner_end
    starts, place = starts[real], place[:n][real].astype(np.int64)
    if not len(starts):
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    new = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(new[1:], len(place)) - 1
    at = place[new]
    return h[at], at, at - starts[last], at - starts[new]


def _chunks(texts: list[bytes]):
    """Runs of texts of about ``CHUNK`` bytes: (first, bytes, ends)."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        if run and size + len(t) > CHUNK:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def _anchor_messages(n_buckets: int):
    """Anchors for each bucket: the first of each in the batch; further ones as known repeats."""

    def run(batches):
        for batch in sized_slices(batches, "text", BATCH):
            ids = batch.column("uid").to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            # of equal texts the least uid, as later copies' anchors are dropped
            least_of: dict[str, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                least_of.setdefault(texts[i], i)
            fresh = sorted(least_of.values())
            parts = []
            raw = [texts[i].encode() for i in fresh]
            for first, some in _chunks(raw):
                ends = np.cumsum([len(t) for t in some])
                h, at, least, most = anchors(np.frombuffer(b"".join(some), dtype=np.uint8), ends)
                doc = np.searchsorted(ends, at, side="right")
                parts.append((h, ids[np.array(fresh, dtype=np.int64)[first + doc]], at - (ends[doc] - np.array([len(t) for t in some])[doc]), least | most << 8))
            if not parts:
                continue
            h, doc, at, reach = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, doc, h))
            h, doc, at, reach = h[order], doc[order], at[order], reach[order]
            head = np.concatenate((h[:1] == h[:1], h[1:] != h[:-1]))
            twice = np.zeros(len(h), dtype=bool)
            twice[:-1] = ~head[1:]
            bucket = (mix64(h) % np.uint64(n_buckets)).astype(np.int64)
            rows = []
            for known in (False, True):
                pick = np.flatnonzero(head != known)
                part = bucket[pick] if not known else np.full(len(pick), int(ids[0]) % n_buckets)
                pick = pick[np.argsort(part, kind="stable")]
                part = np.sort(part)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
                    k = pick[lo:hi]
                    rows.append((int(part[lo]), known, h[k].tobytes(), doc[k].astype("<i8").tobytes(), pack(at[k]), pack(reach[k]), np.packbits(twice[k]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MESSAGE.types)] if rows else [pa.array([], t) for t in _MESSAGE.types], schema=_MESSAGE)

    return run


_MESSAGE = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("h", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("reach", pa.binary()), ("twice", pa.binary())])


def _regrouped(n_buckets: int):
    """Messages to groups of buckets, put together and sent on to the buckets."""

    def flush(parts):
        h, doc, at, reach, twice = (np.concatenate(x) for x in zip(*parts))
        bucket = (mix64(h) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = []
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            k = order[lo:hi]
            rows.append((int(bucket[k[0]]), False, h[k].tobytes(), doc[k].astype("<i8").tobytes(), pack(at[k]), pack(reach[k]), np.packbits(twice[k]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MESSAGE.types)], schema=_MESSAGE)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for h, doc, at, reach, twice in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "at", "reach", "twice"))):
                h = np.frombuffer(h, "<u8")
                parts.append((h, np.frombuffer(doc, "<i8"), unpack(at), unpack(reach), np.unpackbits(np.frombuffer(twice, np.uint8), count=len(h)).astype(bool)))
                size += len(h)
                if size >= REGROUP:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _repeated_anchors(table: pa.Table) -> pa.Table:
    known = np.array(table.column("known").to_pylist(), dtype=bool)
    h = [np.frombuffer(x, "<u8") for x in table.column("h").to_pylist()]
    sizes = [len(x) for x in h]
    h = np.concatenate(h)
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("twice").to_pylist(), sizes)])
    known = np.repeat(known, sizes)
    _, back, times = np.unique(h[~known], return_inverse=True, return_counts=True)
    again[~known] |= times[back] > 1
    again |= known
    doc = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("doc").to_pylist()])
    at = np.concatenate([unpack(x) for x in table.column("at").to_pylist()])
    reach = np.concatenate([unpack(x) for x in table.column("reach").to_pylist()])
    return pa.table({"uid": doc[again], "h": h[again].view(np.int64), "at": at[again].astype(np.int32), "reach": reach[again].astype(np.int32)})


def _stretches(n_buckets: int):
    """Stretches around repeated anchors for each bucket, and what copies in the batch are covered."""

    def run(batches):
        for batch in sized_slices(batches, "text", BATCH >> 1):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("uid").to_pylist()
            entries = []
            for i, found in enumerate(batch.column("found").to_pylist()):
                for f in found:
                    at, least, most = f["at"], f["reach"] & 0xFF, f["reach"] >> 8
                    entries.append((f["h"], ids[i], at, least, most, texts[i][at - most : at + WIDTH - least]))
            entries.sort(key=lambda e: (e[1], e[2]))
            first: dict[tuple, tuple] = {}
            covered = []
            for e in entries:
                key = (e[0], e[3], e[4], e[5])
                if key in first:
                    covered.append((e[1], e[2] - e[4], e[2] + WIDTH - e[3]))
                else:
                    first[key] = e
            rows = []
            if first:
                kept = list(first.values())
                bucket = (mix64(np.array([e[0] for e in kept], dtype=np.int64).view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                    some = [kept[k] for k in order[lo:hi]]
                    rows.append((int(bucket[order[lo]]), None, None, None, np.array([e[1] for e in some], dtype="<i8").tobytes(), pack(np.array([e[2] for e in some])), pack(np.array([e[3] | e[4] << 8 for e in some])), b"".join(e[5] for e in some)))
            rows += [(None, *c, None, None, None, None) for c in covered]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STRETCH.types)] if rows else [pa.array([], t) for t in _STRETCH.types], schema=_STRETCH)

    return run


_STRETCH_DDL = "bucket bigint, uid bigint, start int, stop int, doc binary, at binary, reach binary, bytes binary"
_STRETCH = pa.schema([("bucket", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("doc", pa.binary()), ("at", pa.binary()), ("reach", pa.binary()), ("bytes", pa.binary())])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(doc, at, reach, bytes) of a bucket's stretches."""
    doc = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("doc").to_pylist()])
    at = np.concatenate([unpack(x) for x in table.column("at").to_pylist()])
    reach = np.concatenate([unpack(x) for x in table.column("reach").to_pylist()])
    sizes = WIDTH + (reach >> 8) - (reach & 0xFF)
    data, ends = b"".join(table.column("bytes").to_pylist()), np.cumsum(sizes)
    return doc, at, reach, [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]


def _merged_stretches(table: pa.Table) -> pa.Table:
    """A bucket's messages as one: of equal stretches the earliest stays, and the others are covered."""
    doc, at, reach, stretches = _unpacked(table)
    first: dict[tuple, int] = {}
    covered = []
    for k in np.lexsort((at, doc)).tolist():
        if first.setdefault((int(reach[k]), stretches[k]), k) != k:
            covered.append((None, int(doc[k]), int(at[k] - (reach[k] >> 8)), int(at[k] + WIDTH - (reach[k] & 0xFF)), None, None, None, None))
    kept = np.array(sorted(first.values()), dtype=np.int64)
    rows = [(table.column("bucket")[0].as_py(), None, None, None, doc[kept].astype("<i8").tobytes(), pack(at[kept]), pack(reach[kept]), b"".join(stretches[k] for k in kept)), *covered]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STRETCH.types)], schema=_STRETCH)


def _reduced(stretches: DataFrame) -> DataFrame:
    """The same stretches with equal ones reduced, level by level, where one bucket holds very many bytes.

    Such a bucket has a common line around its anchor; a level puts ``FAN``
    messages together, until a bucket is small or has no equal stretches left.
    """
    sent, before = F.col("bucket").isNotNull(), None
    while True:
        sizes = stretches.where(sent).groupBy("bucket").agg(F.sum(F.octet_length("bytes")).alias("held"), F.count("*").alias("messages")).where((F.col("held") > HOT_BYTES) & (F.col("messages") > 1))
        held = sizes.agg(F.sum("held"), F.sum("messages")).first()
        if not held[0] or before and held[0] > 0.9 * before[0] and held[1] > 0.9 * before[1]:
            return stretches
        before = held
        hot = stretches.join(sizes.select("bucket", F.ceil(F.col("messages") / FAN).alias("groups")), "bucket")
        dealt = hot.withColumn("part", F.pmod(F.xxhash64("doc", "at"), "groups"))
        merged = dealt.groupBy("bucket", "part").applyInArrow(_merged_stretches, _STRETCH_DDL)
        stretches = stage(stretches.join(sizes.select("bucket"), "bucket", "left_anti").unionByName(merged), "stretches")


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Sorts strings by their first differing bytes, reading no string on the way down.

    A node is [depth, {byte at depth: node or leaf}]; a leaf is a list of equal
    strings' numbers. The end of a string is byte -1.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = ("leaf", [i])
            return
        node, path = self.root, []
        while node[0] != "leaf":
            path.append(node)
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        same = _lcp(s, other)
        if same == len(s) == len(other):
            node[1].append(i)
            return
        up = len(path)
        while up and path[up - 1][0] > same:
            up -= 1
        leaf = ("leaf", [i])
        if up and path[up - 1][0] == same:
            path[up - 1][1][self._byte(s, same)] = leaf
            return
        below = path[up] if up < len(path) else node
        new = (same, {self._byte(other, same): below, self._byte(s, same): leaf})
        if up:
            path[up - 1][1][self._byte(s, path[up - 1][0])] = new
        else:
            self.root = new

    def ordered(self) -> list[tuple[int, int]]:
        """(string number, LCP with the one before) in order; the first LCP is 0."""
        out: list[tuple[int, int]] = []
        todo = [(self.root, 0)]
        while todo:
            node, lcp = todo.pop()
            if node[0] == "leaf":
                size = len(self.strings[node[1][0]])
                out += [(i, size if k else lcp) for k, i in enumerate(node[1])]
            else:
                children = sorted(node[1].items())
                todo += [(child, node[0] if k else lcp) for k, (_, child) in reversed(list(enumerate(children)))]
        return out


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, LCP of each place in order with the place before)."""
    n = len(strings)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), dtype=">u8").reshape(n, -1).astype(np.uint64)
    short = np.minimum(sizes, SHALLOW)
    order = np.lexsort((short, *words.T[::-1]))
    w, s = words[order], short[order]
    bits = w[1:] ^ w[:-1]
    lcp = np.zeros(n, dtype=np.int64)
    for k in range(w.shape[1] - 1, -1, -1):
        zeros = sum((bits[:, k] >> np.uint64(56 - 8 * j) == 0).astype(np.int64) for j in range(8))
        lcp[1:] = np.where(bits[:, k] == 0, lcp[1:] + 8 if k < w.shape[1] - 1 else 8, zeros)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(s[1:], s[:-1]))
    tied = np.zeros(n, dtype=bool)
    tied[1:] = (lcp[1:] == SHALLOW) | ((s[1:] == s[:-1]) & (lcp[1:] == s[1:]))
    cuts = np.flatnonzero(~tied)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n]):
        if hi - lo > 1:
            group = order[lo:hi]
            found = BlindTrie([strings[g] for g in group]).ordered()
            order[lo:hi] = group[[f[0] for f in found]]
            lcp[lo + 1 : hi] = [f[1] for f in found[1:]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return rank, lcp


def repeated_spans(doc: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) covered by windows of these stretches that also start earlier."""
    age = np.lexsort((at, doc))
    doc, at, least, most = doc[age], at[age], least[age], most[age]
    stretches = [stretches[k] for k in age]
    rank_r, lcp_r = deep_shallow([s[m:] for s, m in zip(stretches, most.tolist())])
    rank_l, lcp_l = deep_shallow([s[:m][::-1] for s, m in zip(stretches, most.tolist())])
    covered = np.zeros((len(doc), SPAN + 3), dtype=bool)
    for left in range(SPAN + 1):
        real = np.flatnonzero((least <= left) & (left <= most))
        if len(real) < 2:
            continue
        after = np.cumsum(lcp_r < WIDTH - left)[rank_r[real]]
        before = np.cumsum(lcp_l < left)[rank_l[real]]
        _, first, back = np.unique(after * (len(doc) + 1) + before, return_index=True, return_inverse=True)
        covered[real, left + 1] = first[back] != np.arange(len(real))
    edge = np.diff(covered.astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return doc[row], at[row] - (high - 1), at[row] - low + WIDTH


def _sorted_bucket(table: pa.Table) -> pa.Table:
    doc, at, reach, stretches = _unpacked(table)
    uid, start, stop = repeated_spans(doc, at, reach & 0xFF, reach >> 8, stretches)
    return pa.table({"uid": uid, "start": start.astype(np.int32), "stop": stop.astype(np.int32)})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    for batch in batches:
        rows = []
        for uid, text, spans in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data, at, kept = text.encode(), 0, []
            runs = merged([(s["start"], s["stop"]) for s in spans])
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((uid, len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CUT.types)] if rows else [pa.array([], t) for t in _CUT.types], schema=_CUT)


_CUT = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
_CUT_DDL = "uid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with uid and text, their profile): uid orders documents as doc_id does.

    It is the doc_id itself where that names each row. Otherwise distinct
    (doc_id, text) pairs are numbered in order, nulls first, by the ranges and
    places of a sort, and equal rows share a number. The result is the same.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    profile = stage(plain.select("doc_id", sha.alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes")), "profile")
    rows, ids = profile.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return plain.select(F.col("doc_id").alias("uid"), "text"), profile.withColumn("uid", F.col("doc_id"))
    pairs = profile.select(F.col("doc_id").alias("d"), F.col("sha").alias("s")).distinct().orderBy(F.asc_nulls_first("d"), "s")
    numbered = stage(pairs.withColumn("uid", F.monotonically_increasing_id()), "uids")
    same = F.col("doc_id").eqNullSafe(F.col("d"))
    texts = plain.withColumn("sha", sha).join(numbered, same & (F.col("sha") == F.col("s"))).select("uid", "text").dropDuplicates(["uid"])
    return texts, profile.join(numbered, same & (F.col("sha") == F.col("s"))).select("doc_id", "sha", "n_bytes", "uid")


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, cut): each row's profile, and what is left of documents that lose bytes.

    profile has doc_id, sha, n_bytes, uid and ``first``, the uid of the earliest
    equal text; cut has uid, n_removed, n_spans, kept_sha256 and kept for the
    documents that are the first of their text and lose some bytes. kept is the
    text left, without what remains of characters that are cut.
    """
    texts, profile = _keyed(docs)
    firsts = stage(profile.groupBy("sha", "n_bytes").agg(F.min("uid").alias("first"), F.count("*").alias("copies")), "first-copies")
    profile = stage(hot_join(profile, firsts, ["sha", "n_bytes"], "copies"), "firsts")
    size = profile.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(4, -(-size // BUCKET))
    long = texts.where(F.octet_length("text") >= WIDTH)
    message = "bucket bigint, known boolean, h binary, doc binary, at binary, reach binary, twice binary"
    n_groups = min(n_buckets, GROUPS)
    n_buckets = -(-n_buckets // n_groups) * n_groups
    asked = long.mapInArrow(_anchor_messages(n_groups), message)
    if n_buckets > n_groups:
        fresh = asked.where("not known").repartition(n_buckets, "bucket", F.pmod(F.xxhash64("h"), F.lit(n_buckets // n_groups)))
        asked = fresh.mapInArrow(_regrouped(n_buckets), message).unionByName(asked.where("known"))
    repeated = asked.groupBy("bucket").applyInArrow(_repeated_anchors, "uid bigint, h bigint, at int, reach int")
    copies = profile.where("uid <> first").select("uid").distinct()
    lists = repeated.groupBy("uid").agg(F.collect_list(F.struct("h", "at", "reach")).alias("found")).join(copies, "uid", "left_anti")
    with_anchors = stage(long.join(lists, "uid"), "repeat-texts")
    stretches = _reduced(stage(with_anchors.mapInArrow(_stretches(n_buckets), _STRETCH_DDL), "stretches"))
    sorted_ = stretches.where("bucket is not null").select("bucket", "doc", "at", "reach", "bytes").groupBy("bucket").applyInArrow(_sorted_bucket, "uid bigint, start int, stop int")
    spans = sorted_.unionByName(stretches.where("bucket is null").select("uid", "start", "stop")).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return profile, with_anchors.select("uid", "text").join(spans, "uid").mapInArrow(_cut, _CUT_DDL)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Null text is empty. Equal rows (doc_id and text) count as one document and
    have the same result; different texts under one doc_id, or none, are taken
    in the order of their SHA-256, nulls first. Extra columns are ignored; an
    empty table gives an empty result.
    """
    profile, cut = remove_repeats(docs)
    both = profile.join(cut.drop("kept"), "uid", "left")
    gone = (F.col("uid") != F.col("first")) & (F.col("n_bytes") >= WIDTH)
    return both.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns, with repeated bytes gone from text and n_chars counted anew.

    Rows of one doc_id and text lose the same bytes; null texts stay null; what
    remains of a character that is cut goes too; an empty table stays empty.
    """
    profile, cut = remove_repeats(docs)
    gone = (F.col("uid") != F.col("first")) & (F.col("n_bytes") >= WIDTH)
    left = profile.join(cut.select("uid", "kept"), "uid", "left").where(gone | F.col("kept").isNotNull())
    own, key, kept = (free_name(docs, n) for n in ("own", "key", "kept"))
    left = left.select(row_name(F.col("doc_id"), F.col("sha")).alias(key), F.when(gone, "").otherwise(F.col("kept")).alias(kept)).distinct()
    both = docs.withColumn(own, row_name(F.col("doc_id"), text_sha())).join(left, F.col(own) == F.col(key), "left")
    text = F.coalesce(kept, "text")
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select([new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))

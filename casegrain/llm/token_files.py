"""Token-id files compressed by Re-Pair grammars.

Format. A table of shards in Parquet, in ascending doc_id order (a file per
range of doc_id; ``part`` and ``shard`` give the order). A shard holds about
eight MB of text:

* ``rules``: pairs of symbols; rule k defines the nonterminal ``base + 1 + k``.
  A symbol below ``base`` is a token id, ``base`` itself ends a document and
  stands for the end id, and a rule names only earlier symbols.
* ``lengths``: how many ids each rule expands to.
* ``symbols``: the compressed sequence; no rule crosses a document's end.
* ``doc_ids``, ``doc_ids_n`` and ``doc_symbols``: each document's id, number of ids and
  number of symbols, so one document is decoded alone.
* ``first``: ids in the same part before this shard.

All arrays are little-endian; symbols take ``width`` bytes. A shard's grammar
is Re-Pair's: frequent pairs are replaced by nonterminals until no pair is left
that occurs ``LEAST_USES`` times. That is the one stopping rule: a rule is kept
in three words (its pair and its length) and each use saves one.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, ragged, read_table, sized_slices, split_words

END_ID = 1
#: Text that one part of the files is made from.
PART_BYTES = 24 << 20
#: Bytes of pieces and their ids that a worker remembers, about 400,000 words.
MEMORY = 16 << 20
#: Occurrences from which a pair's rule pays.
LEAST_USES = 4
#: A round replaces pairs with at least this part of the most frequent pair's occurrences.
STEP = 16
#: A sweep takes as candidates the pairs with at least this part of the occurrences that its first round asks for.
DEPTH = 3
_SLOTS = 20
#: Parts whose sizes are added up together.
PARTS_TOGETHER = 1024

_SCHEMA = (
    "part int, shard int, first bigint, n_ids bigint, first_doc bigint, last_doc bigint, base int, width int, "
    "rules binary, lengths binary, symbols binary, doc_ids array<bigint>, doc_ids_n binary, doc_symbols binary"
)


#: Letters and a run of punctuation, for which lower case and composition are plain: two pre-tokens at most.
_PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)(?P<marks>[!-&(-/:;=-@\\[-`{-~]*)$"


class Encoder:
    """Ids of words by the tokenizers library, each distinct pre-token encoded once while remembered.

    The tokenizer's pre-tokenizer drops white space and no pre-token spans it,
    so a text's ids are its words' ids in order. Words of letters and then
    punctuation are two pre-tokens; their distinct letters, in lower case, go
    through the library's model many at a time. Other words take the whole
    tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.base, dtype=bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self):
        self.pieces = pa.array([], pa.string())
        self.flat, self.starts = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, new: pa.Array) -> None:
        parts, ends, pieces = [self.flat], [self.starts], new.to_pylist()
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            joined = [" ".join(some[k : k + 256]) for k in range(0, len(some), 256)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
            parts.append(ids)
            ends.append(ends[-1][-1] + np.flatnonzero(self.last[ids]) + 1)
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.flat, self.starts = np.concatenate(parts), np.concatenate(ends)
        assert len(self.starts) == len(self.pieces) + 1

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece; -1 for an empty one."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.cast(pa.string())
        found = pc.index_in(distinct, value_set=self.pieces)
        filled = pc.greater(pc.binary_length(distinct), 0)
        new = pc.and_(filled, pc.is_null(found))
        number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        number[fresh] = len(self.pieces) + np.arange(len(fresh))
        self._learn(distinct.filter(new))
        return number[coded.indices.to_numpy(zero_copy_only=False)]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the words in order, where each word's ids end)."""
        if self.pieces.nbytes + self.flat.nbytes + self.starts.nbytes > MEMORY:
            self._forget()
        found = pc.extract_regex(words, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        letters, marks = (pc.struct_field(found.filter(pa.array(plain)), k) for k in ("letters", "marks"))
        pieces = self._numbers(pa.concat_arrays([pc.utf8_lower(letters), marks])).reshape(2, -1).T.ravel()
        sizes = np.where(pieces < 0, 0, self.starts[pieces + 1] - self.starts[pieces])
        ids = [self.flat[ragged(self.starts[pieces], sizes)]]
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[plain] = sizes.reshape(-1, 2).sum(axis=1)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        lengths[~plain] = [len(x) for x in rest]
        out, ends = np.zeros(int(lengths.sum()), dtype=np.uint32), np.cumsum(lengths)
        for mask, some in ((plain, ids[0]), (~plain, np.array([i for x in rest for i in x], dtype=np.uint32))):
            out[ragged((ends - lengths)[mask], lengths[mask])] = some
        return out, ends


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, which it keeps from task to task."""
    return Encoder(path)


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


def _odd_in_run(a: np.ndarray, b: np.ndarray, pos: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Indices of the pairs that don't count: of a run of one symbol, every second."""
    at = np.flatnonzero(a == b)
    if not len(at):
        return at
    starts = np.concatenate(([True], (after[pos[at[:-1]]] != pos[at[1:]]) | (a[at[1:]] != a[at[:-1]])))
    first = np.flatnonzero(starts)
    return at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 1]


def repair(symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, compressed symbols) of a sequence in which ``base`` is never paired.

    Pairs are counted exactly. A round ranks the most frequent ones, and an
    occurrence is replaced where no overlapping one ranks higher; what loses is
    counted again in the next.

    A sweep looks at every pair that may still be frequent and takes those with
    ``floor`` occurrences or more as candidates; rounds look at candidates
    alone, while they ask for no fewer. Nothing is missed by that: replacing only makes
    pairs with new symbols, which become candidates at once, and any other pair
    becomes rarer. For the same reason a pair under ``LEAST_USES`` is never looked at
    again, nor one under ``floor`` until the next sweep.
    """
    seq, n_rules, rules = np.append(symbols, base).astype(np.uint32), 0, [np.zeros((0, 2), dtype=np.uint32)]
    live, gone = (seq[:-1] != base) & (seq[1:] != base), np.zeros(len(seq), dtype=bool)
    floor, sweep = len(seq), True
    while True:
        if sweep:
            seq, live = seq[~gone], live[~gone[:-1]]
            gone = np.zeros(len(seq), dtype=bool)
            after, before = np.arange(1, len(seq) + 1, dtype=np.int32), np.arange(-1, len(seq) - 1, dtype=np.int32)
            pos = np.flatnonzero(live)
        a, b = seq[pos], seq[after[pos]]
        key = a.astype(np.uint64) << np.uint64(32) | b
        # a slot's count is no less than that of any pair in it
        bits = min(_SLOTS, len(key).bit_length() + 1)
        slot = _slots(key, bits)
        held = np.bincount(slot, minlength=1 << bits).astype(np.int32)[slot]
        live[pos[held < LEAST_USES]] = False
        if sweep:
            floor = max(LEAST_USES, min(floor // 2, int(held.max(initial=0)) // (DEPTH * STEP)))
        often = np.flatnonzero(held >= floor)
        pos, key, slot = pos[often], key[often], slot[often]
        counts = np.ones(len(pos), dtype=bool)
        counts[_odd_in_run(a[often], b[often], pos, after)] = False
        ordered = np.sort(key[counts])
        heads = np.flatnonzero(np.concatenate((ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1])))
        times = np.diff(np.append(heads, len(ordered)))
        most = int(times.max(initial=0))
        enough = max(LEAST_USES, most // STEP)
        sweep = enough < floor
        if sweep:
            continue
        if most < LEAST_USES:
            break
        top = times >= enough
        pairs, times = ordered[heads[top]], times[top]
        rank_of = np.empty(len(pairs), dtype=np.int32)
        by_rank = np.lexsort((pairs, -times))
        rank_of[by_rank] = np.arange(len(pairs))
        in_slot = np.full(1 << bits, -1, dtype=np.int32)
        in_slot[_slots(pairs, bits)] = np.arange(len(pairs))
        at = in_slot[slot]
        asked = np.flatnonzero((at >= 0) & counts)
        at, key, hot = at[asked], key[asked], pos[asked]
        other = np.flatnonzero(pairs[at] != key)
        at[other] = np.minimum(np.searchsorted(pairs, key[other]), len(pairs) - 1)
        hit = pairs[at] == key
        hot, rank = hot[hit], rank_of[at[hit]]
        best = np.ones(len(hot), dtype=bool)
        touch = after[hot[:-1]] == hot[1:]
        best[1:] &= ~touch | (rank[1:] < rank[:-1])
        best[:-1] &= ~touch | (rank[:-1] < rank[1:])
        hot, rank = hot[best], rank[best]
        uses = np.bincount(rank, minlength=len(pairs))
        good = np.flatnonzero(uses >= LEAST_USES)
        number = np.zeros(len(pairs), dtype=np.uint32)
        number[good] = base + 1 + n_rules + np.arange(len(good))
        some = pairs[by_rank[good]]
        rules.append(np.stack([some >> np.uint64(32), some & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(good)
        use = uses[rank] >= LEAST_USES
        hot, rank = hot[use], rank[use]
        seq[hot] = number[rank]
        second = after[hot]
        third = after[second]
        after[hot], before[third] = third, hot
        gone[second] = True
        first = before[hot]
        first = first[first >= 0]
        again = np.zeros(len(live), dtype=bool)
        again[pos] = True
        again[second] = live[second] = False
        again[hot] = live[hot] = seq[third] != base
        again[first] = live[first] = seq[first] != base
        pos = np.flatnonzero(again)
    return np.concatenate(rules), seq[~gone][:-1]


def _lengths(rules: np.ndarray, base: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(ids that each symbol stands for, ranges of rules that name only symbols before the range)."""
    lengths, ranges, start = np.ones(base + 1 + len(rules), dtype=np.int64), [], 0
    newest = np.maximum.accumulate(rules.max(axis=1, initial=0).astype(np.int64)) - base - 1
    while start < len(rules):
        stop = int(np.searchsorted(newest, start))
        lengths[base + 1 + start : base + 1 + stop] = lengths[rules[start:stop]].sum(axis=1)
        ranges.append((start, stop))
        start = stop
    return lengths, ranges


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    return _lengths(rules, base)[0][base + 1 :].astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; ``base`` becomes the end id."""
    lengths, ranges = _lengths(rules, base)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    table = np.empty(int(ends[-1]), dtype="<u4")
    table[: base + 1] = np.arange(base + 1)
    table[base] = END_ID
    for start, stop in ranges:
        parts = rules[start:stop].ravel()
        table[starts[base + 1 + start] : ends[base + stop]] = table[ragged(starts[parts], lengths[parts])]
    return table[ragged(starts[symbols], lengths[symbols])]


def unfold(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """``expand`` of few symbols, level by level, without a table of all rules."""
    out = symbols.astype(np.int64)
    while (high := out > base).any():
        at = np.cumsum(1 + high) - 1 - high
        new = np.empty(len(out) + int(high.sum()), dtype=np.int64)
        new[at[~high]] = out[~high]
        new[at[high]], new[at[high] + 1] = rules[out[high] - base - 1].T
        out = new
    return np.where(out == base, END_ID, out).astype("<u4")


def _shards(tokenizer: str):
    def run(batches):
        from pyspark import TaskContext

        encoder, part, shard, first = _encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        base = encoder.base
        for batch in sized_slices(batches, "text"):
            codes, offsets, words = split_words(batch.column("text"), as_list=False)
            flat, stops = encoder.words(words)
            lengths = np.diff(stops, prepend=0)[codes]
            ids = flat[ragged(stops[codes] - lengths, lengths)]
            ends = np.concatenate(([0], np.cumsum(lengths)))[offsets[1:]]
            symbols = np.insert(ids, ends, np.uint32(base))
            doc_n = np.diff(ends, prepend=0) + 1
            rules, packed = repair(symbols, base)
            stops = np.flatnonzero(packed == base) + 1
            width = 2 if base + 1 + len(rules) < 65536 else 4
            kind = f"<u{width}"
            doc_ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "first": first, "n_ids": len(symbols), "first_doc": doc_ids[0], "last_doc": doc_ids[-1], "base": base, "width": width,
                "rules": rules.astype(kind).tobytes(), "lengths": rule_lengths(rules, base).astype("<u4").tobytes(), "symbols": packed.astype(kind).tobytes(),
                "doc_ids": doc_ids, "doc_ids_n": doc_n.astype("<u4").tobytes(), "doc_symbols": np.diff(stops, prepend=0).astype("<u4").tobytes(),
            }], schema=_ARROW)
            shard, first = shard + 1, first + len(symbols)

    return run


_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("base", pa.int32()), ("width", pa.int32()),
     ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_ids_n", pa.binary()), ("doc_symbols", pa.binary())]
)


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode whole texts and write them to ``path`` in ascending doc_id order.

    Null and empty texts are an end id alone; a null doc_id sorts first; rows
    of one doc_id follow each other by text; extra columns are not written.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    ordered = narrow.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer), _SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kind = f"<u{row['width']}"
                ids = expand(np.frombuffer(row["symbols"], kind), np.frombuffer(row["rules"], kind).astype(np.uint32).reshape(-1, 2), row["base"])
                n = np.frombuffer(row["doc_ids_n"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                packs = [ids[e - k : e].tobytes() for e, k in zip(ends, n)]
                columns = {
                    "part": pa.array([row["part"]] * len(n), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["first"] + ends - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in packs], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(packs, pa.binary())} if with_ids else {}))

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and ids (packed 32-bit), if they are asked for.

    The ids are decoded in any case.
    """
    shards = spark.read.schema(_SCHEMA).parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("together", F.expr(f"part div {PARTS_TOGETHER}"))
    bases, run = [], 0
    for row in sizes.groupBy("together").agg(F.sum("n").alias("n")).orderBy("together").collect():  # a row for each 1024 parts
        bases.append((row.together, run))
        run += row.n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("together").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("before", before).join(spark.createDataFrame(bases, "together bigint, base bigint"), "together").select("part", (F.col("base") + F.col("before")).alias("base"))
    found = shards.mapInArrow(_documents(with_ids), "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    return found.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document, by decoding its symbols alone; one list for each row it has."""
    shards = spark.read.schema(_SCHEMA).parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "shard")
    found = []
    for row in shards.toLocalIterator():
        kind = f"<u{row['width']}"
        symbols, rules = np.frombuffer(row["symbols"], kind), np.frombuffer(row["rules"], kind).astype(np.uint32).reshape(-1, 2)
        ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))
        for k in [k for k, d in enumerate(row["doc_ids"]) if d == doc_id]:
            found.append(unfold(symbols[ends[k - 1] if k else 0 : ends[k]], rules, row["base"]).tolist())
    return found


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_tokens(spark, path, with_ids=False)

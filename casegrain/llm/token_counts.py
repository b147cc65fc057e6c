"""Token counts from distinct pre-tokens, without materialising ids.

A sentencepiece BPE model whose pieces hold no space after another character
never merges across the start of a run of spaces, so a text's token count is
the sum over its pre-tokens (a run of spaces and what follows it). Each block
of documents keeps per-document pre-token frequencies and sends its distinct
pre-tokens to the bucket of their hash; a bucket counts the pieces of each
distinct pre-token once and answers every block; the block then sums
frequency times pieces. A block sends ``MOST_BUCKETS`` messages at most, so
messages grow with the text; blocks are dealt to sets of about ``SET_BLOCKS``,
each with its own buckets, so what a bucket holds doesn't grow with it. A
pre-token is counted once a set (12 GB of text).

Defined results: null and empty texts count 0 tokens; repeated rows are
counted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sized_slices, stage

_BLOCK_SCHEMA = (
    "block string, bucket int, words binary, doc_ids array<bigint>, sizes array<bigint>, "
    "ends array<bigint>, codes binary, counts binary"
)
#: Distinct pre-tokens are dealt to one bucket for so many blocks of text.
BLOCKS_PER_BUCKET = 2
BLOCK_BYTES = 12 << 20
MOST_BUCKETS = 512
SET_BLOCKS = 1024


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without the first of its spaces."""
    if not text:
        return []
    return [x[1:] for x in re.findall(r" +[^ ]*", " " + text.replace("▁", " "))]


def _load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless no piece of the model runs on past the start of a space run."""
    sp = _load(model)
    bad = [i for i in range(sp.vocab_size()) if "▁" in sp.id_to_piece(i).lstrip("▁")]
    if bad:
        raise ValueError(f"{model} has pieces across pre-tokens, such as id {bad[0]}")


def pack(values: np.ndarray) -> bytes:
    """Integers as zstandard-compressed 32-bit words, the bytes of one weight together."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _sorted(vocabulary: list[str]) -> tuple[list[str], np.ndarray]:
    """The vocabulary in order, which compresses better, and where each word went."""
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return [vocabulary[k] for k in order], back


def _pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.array([len(w) for w in words]))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 3)


def _unpack_words(data: bytes) -> pa.Array:
    cut = 4 + int.from_bytes(data[:4], "little")
    ends = np.concatenate(([0], np.cumsum(unpack(data[4:cut])))).astype("<i4")
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(zstandard.decompress(data[cut:])))


def _block_rows(n_buckets: int, block_bytes: int):
    def rows(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in sized_slices(batches, "text", block_bytes):
            texts = pc.fill_null(batch.column("text"), "")
            odd = pc.match_substring_regex(texts, "  |^ | $|▁").to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(odd), "", texts)
            lists = pc.split_pattern(plain, " ")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            vocabulary = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            real = ~empty[doc]
            doc, codes = doc[real], codes[real]
            if odd.any():
                at = {w: i for i, w in enumerate(vocabulary)}
                extra = [(i, at.setdefault(w, len(at))) for i in np.flatnonzero(odd) for w in pre_tokens(texts[int(i)].as_py())]
                vocabulary = list(at)
                doc = np.concatenate((doc, np.array([x[0] for x in extra], dtype=np.int64)))
                codes = np.concatenate((codes, np.array([x[1] for x in extra], dtype=np.int64)))
            vocabulary, back = _sorted(vocabulary)
            codes = back[codes]
            bucket = np.array([zlib.crc32(w.encode()) % n_buckets for w in vocabulary], dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            keys, counts = np.unique(doc * max(1, len(vocabulary)) + place[codes], return_counts=True)
            doc, codes = np.divmod(keys, max(1, len(vocabulary)))
            ends = np.searchsorted(doc, np.arange(1, batch.num_rows + 1))
            block = f"{part}-{seq}"
            seq += 1
            sizes = pc.binary_length(texts).to_pylist()
            steps = np.diff(codes, prepend=0)  # codes ascend in a document, so steps are small
            out = [(block, None, None, batch.column("doc_id").to_pylist(), sizes, ends.tolist(), pack(steps), pack(counts))]
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                some = [vocabulary[k].encode() for k in order[cuts[b] : cuts[b + 1]]]
                out.append((block, b, _pack_words(some), *[None] * 5))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    return rows


_ARROW = pa.schema(
    [("block", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
     ("sizes", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary()), ("counts", pa.binary())]
)


def _answers(model: str):
    def answers(table: pa.Table) -> pa.Table:
        lists = [_unpack_words(w) for w in table.column("words").to_pylist()]
        words = pa.concat_arrays(lists)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        sp, pieces = _load(model), np.zeros(len(distinct), dtype=np.int32)
        for at in range(0, len(distinct), 10_000):
            some = distinct[at : at + 10_000]
            pieces[at : at + len(some)] = [len(x) if w else 1 for w, x in zip(some, sp.encode(some, num_threads=1))]
        counts = pieces[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        packed = [pack(counts[ends[i] : ends[i + 1]]) for i in range(len(lists))]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "pieces": pa.array(packed, pa.binary())})

    return answers


def _sums(batches):
    for batch in batches:
        for row in batch.to_pylist():
            parts = sorted(row["answers"] or [], key=lambda x: x["bucket"])
            pieces = np.concatenate([np.zeros(0, np.int64), *(unpack(x["pieces"]) for x in parts)])
            codes, counts = np.cumsum(unpack(row["codes"])), unpack(row["counts"])
            run = np.concatenate(([0], np.cumsum(pieces[codes] * counts)))
            ends = np.array([0, *row["ends"]], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(np.diff(run[ends]), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    check_model(model)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = min(MOST_BUCKETS, max(4, -(-total // (block_bytes * BLOCKS_PER_BUCKET))))
    n_sets = max(1, -(-total // (block_bytes * SET_BLOCKS)))
    blocks = stage(narrow.mapInArrow(_block_rows(n_buckets, block_bytes), _BLOCK_SCHEMA), "token-blocks")
    asked = blocks.where("bucket is not null").select("block", "bucket", "words").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_sets)))
    answered = asked.groupBy("bucket", "part").applyInArrow(_answers(model), "block string, bucket int, pieces binary")
    replies = answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "pieces")).alias("answers"))
    payload = blocks.where("bucket is null").drop("bucket", "words")
    summed = payload.join(replies, "block", "left").mapInArrow(_sums, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Operators on documents against brute force on a small corpus."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casegrain.llm import decontaminate, packing, quality, simhash, suffix_dedup, token_counts, token_files, toxicity
from casegrain.llm.components import components

tokenizers = pytest.importorskip("public_tokenizers")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# packing


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= x) - x for x in lengths)


def test_buckets_are_optimal():
    import itertools

    lengths = [1, 1, 2, 5, 5, 9, 13, 13, 13, 20]
    ends = packing.choose_buckets(collections.Counter(lengths), 3)
    best = min(padding(lengths, (*c, 20)) for c in itertools.combinations(sorted(set(lengths))[:-1], 2))
    assert padding(lengths, ends) == best
    assert packing.choose_buckets({}, 3) == [] and packing.choose_buckets({4: 2}, 3) == [4]


def test_packing(docs, empty, corpus):
    rows = packing.pack(docs, context=100, buckets=4, budget=400).collect()
    held = collections.defaultdict(int)
    for r in rows:
        held[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_length
    assert held == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus}
    batches = collections.Counter(r.batch for r in rows)
    length = {r.batch: r.bucket_length for r in rows}
    assert all(n <= max(1, 400 // max(1, length[b])) for b, n in batches.items())
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert packing.pack(empty).count() == 0


def test_packing_in_tokens(docs, empty, corpus):
    import sentencepiece

    model = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    held = collections.Counter()
    for r in packing.pack(docs, model, context=100).collect():
        held[r.doc_id] += r.n_tokens
    assert held == {i: len(sp.encode(t or "")) for i, t in corpus}
    assert packing.pack(empty, model).count() == 0


def test_packing_deals_shared_ids_apart(spark):
    table = spark.range(4000).selectExpr("if(id % 3 = 0, null, 7) as doc_id", "'a b c' as text").repartition(3)
    rows = packing.pack(table, group=100).collect()
    slots = collections.Counter(tuple(r.batch.split("-")[:2]) for r in rows)
    assert len(rows) == 4000 and len(slots) == 40 and max(slots.values()) < 160


# token files and counts


def test_token_files(spark, docs, empty, corpus, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(docs, path, str(tmp_path / "t"))
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    t, start = Tokenizer.from_file(path), 0
    for r, (i, text) in zip(got, corpus, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        packed = np.array(ids, dtype="<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(packed), packed)
        start += len(ids)
        if i in (0, 3, 70):
            assert token_files.read_document(spark, str(tmp_path / "t"), i) == [ids]
    token_files.write_tokens(empty, path, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def pair_counts(seq, base):
    """Occurrences of each pair without ``base``, of a run of one symbol every second."""
    found, last = collections.Counter(), None
    for k in range(len(seq) - 1):
        pair = (seq[k], seq[k + 1])
        if base in pair or last == (k - 1, pair):
            last = None
            continue
        found[pair] += 1
        last = (k, pair) if pair[0] == pair[1] else None
    return found


def plain_repair(seq, base):
    """Re-Pair one rule at a time, always for the most frequent pair."""
    seq, rules = list(seq), 0
    while (found := pair_counts(seq, base)) and (best := max(found.items(), key=lambda x: (x[1], x[0])))[1] >= token_files.LEAST_USES:
        new, k = [], 0
        while k < len(seq):
            if tuple(seq[k : k + 2]) == best[0]:
                new.append(base + 1 + rules)
                k += 2
            else:
                new.append(seq[k])
                k += 1
        seq, rules = new, rules + 1
    return rules, len(seq)


def test_repair():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 60, 500):
        words = rng.integers(0, 40, size=(20, 6))
        seq = words[rng.integers(0, 20, n)].ravel().astype(np.uint32)
        seq[rng.random(len(seq)) < 0.02] = 50
        rules, packed = token_files.repair(seq, 50)
        for way in (token_files.expand, token_files.unfold):
            assert np.array_equal(way(packed, rules, 50), np.where(seq == 50, token_files.END_ID, seq))
        assert all(max(r) <= 50 + k for k, r in enumerate(rules.tolist())) and 50 not in rules
        assert len(rules) == len(set(map(tuple, rules.tolist())))
        assert max(pair_counts(packed.tolist(), 50).values(), default=0) < token_files.LEAST_USES
        n_rules, size = plain_repair(seq.tolist(), 50)
        assert len(packed) + 3 * len(rules) <= 1.1 * (size + 3 * n_rules) + 6
    for runs in (np.zeros(1000, dtype=np.uint32), np.array([0] * 9 + [50] + [0] * 7 + [1] + [0] * 30, dtype=np.uint32)):
        rules, packed = token_files.repair(runs, 50)
        assert np.array_equal(token_files.expand(packed, rules, 50), np.where(runs == 50, token_files.END_ID, runs))
        assert max(pair_counts(packed.tolist(), 50).values(), default=0) < token_files.LEAST_USES


def plain_rounds(seq, base):
    """Re-Pair by rounds that count every pair anew."""
    seq, rules = list(seq), []
    while (found := pair_counts(seq, base)) and max(found.values()) >= token_files.LEAST_USES:
        enough = max(token_files.LEAST_USES, max(found.values()) // token_files.STEP)
        rank = {p: r for r, p in enumerate(sorted((p for p in found if found[p] >= enough), key=lambda p: (-found[p], p)))}
        at, last = {}, None
        for k in range(len(seq) - 1):
            pair = (seq[k], seq[k + 1])
            last = None if last == (k - 1, pair) else (k, pair) if pair[0] == pair[1] else None
            if pair in rank and (pair[0] != pair[1] or last):
                at[k] = rank[pair]
        at = {k: r for k, r in at.items() if r < at.get(k - 1, len(rank)) and r < at.get(k + 1, len(rank))}
        uses = collections.Counter(at.values())
        number = {}
        for pair, r in rank.items():
            if uses[r] >= token_files.LEAST_USES:
                number[r] = base + 1 + len(rules)
                rules.append(pair)
        at = {k: number[r] for k, r in at.items() if r in number}
        seq = [at.get(k, s) for k, s in enumerate(seq) if k - 1 not in at]
    return rules, seq


def test_repair_by_rounds():
    rng = np.random.default_rng(4)
    for n, symbols, length, runs in ((300, 6, 40, 1), (2000, 40, 30, 1), (3000, 200, 12, 1), (1000, 5, 8, 6)):
        words = rng.integers(0, symbols, size=(40, length))
        seq = words[np.minimum(rng.zipf(1.5, n // 5), 40) - 1].ravel().astype(np.uint32)
        seq = np.repeat(seq, rng.integers(1, runs + 1, len(seq)))
        seq[rng.random(len(seq)) < 0.02] = 200
        rules, packed = token_files.repair(seq, 200)
        plain, left = plain_rounds(seq.tolist(), 200)
        assert list(map(tuple, rules.tolist())) == plain and packed.tolist() == left


def test_rounds_look_at_candidates(monkeypatch):
    rng, sort, looked_at = np.random.default_rng(4), np.sort, []
    monkeypatch.setattr(np, "sort", lambda x: looked_at.append(len(x)) or sort(x))
    phrase, rest = rng.permutation(200)[:48], rng.integers(0, 80, 30_000)
    seq = np.concatenate((np.tile(phrase, 800), rest)).astype(np.uint32)
    rules, packed = token_files.repair(seq, 200)
    assert sum(looked_at) <= 4 * len(seq)
    monkeypatch.undo()
    plain, left = plain_rounds(seq.tolist(), 200)
    assert list(map(tuple, rules.tolist())) == plain and packed.tolist() == left


@pytest.mark.parametrize("memory", [0, 2000, 16 << 20])
def test_encoder_remembers_a_bounded_amount(monkeypatch, memory):
    monkeypatch.setattr(token_files, "MEMORY", memory)
    encoder = token_files.Encoder(tokenizers.path("word_bpe_49k.json"))
    for words in (["one,", "two", "one"], ["two", "three!?", "\u00e4", "4,5", "one"], ["4", "5.5"], ["acgt" * 400], ["five", "\u00c4;"], ["one", "five"]):
        for kind in (pa.string(), pa.large_string()):
            before = encoder.pieces.nbytes + encoder.flat.nbytes + encoder.starts.nbytes
            ids, ends = encoder.words(pa.array(words, kind))
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in encoder.tokenizer.encode_batch(words, add_special_tokens=False)]
            assert before <= memory or len(encoder.pieces) <= 2 * len(words)
    assert encoder.words(pa.array([], pa.string()))[0].tolist() == []


def test_encoder_is_kept_and_ids_stay(spark, docs, tmp_path):
    path = tokenizers.path("word_bpe_49k.json")
    assert token_files._encoder(path) is token_files._encoder(path)
    token_files.write_tokens(docs, path, str(tmp_path / "t"))
    lean, full = (token_files.read_tokens(spark, str(tmp_path / "t"), with_ids=x) for x in (False, True))
    assert lean.columns == full.drop("ids").columns
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, full.drop("ids").collect()))


def test_token_counts(docs, empty, corpus, monkeypatch):
    import sentencepiece

    model = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = by_id(token_counts.count_tokens(docs, model, limit=100, block_bytes=2000))
    for i, t in corpus:
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(empty, model).count() == 0
    monkeypatch.setattr(token_counts, "MOST_BUCKETS", 3)
    monkeypatch.setattr(token_counts, "SET_BLOCKS", 2)
    assert {i: tuple(r) for i, r in by_id(token_counts.count_tokens(docs, model, limit=100, block_bytes=2000)).items()} == {i: tuple(r) for i, r in got.items()}
    for odd in (" ", "a ", "  a", "<s> </s>", "▁▁x", "\n\n", "😀 ü"):
        assert sum(len(sp.encode(p)) if p else 1 for p in token_counts.pre_tokens(odd)) == len(sp.encode(odd))


# deduplication


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(b for b, c in zip(data, cover) if not c)
        out[i] = (len(data), sum(cover), sum(1 for k in range(len(cover)) if cover[k] and not (k and cover[k - 1])), hashlib.sha256(rest).hexdigest(), rest)
    return out


def test_suffix_dedup(spark, docs, empty, corpus):
    want = brute_repeats(corpus)
    got = by_id(suffix_dedup.suffix_dedup(docs))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    left = by_id(suffix_dedup.drop_repeats(docs))
    assert left.keys() == dict(corpus).keys() and left[0].asDict().keys() == set(docs.columns)
    assert all((left[i].text or "") == want[i][4].decode("utf-8", "ignore") for i, _ in corpus)


def test_suffix_dedup_of_shared_ids(spark, corpus):
    a, b = corpus[1][1] + " tail" * 30, corpus[2][1] + " tail" * 30
    rows = [(1, a), (1, a), (1, b), (None, b), (None, None)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 5
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute_repeats([(k, k[1]) for k in order])
    by = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept_sha256) for r in got}
    assert by == {(k[0], w[0]): (w[1], w[3]) for k, w in want.items()}


def test_suffix_dedup_of_copies_out_of_order(spark, prose_of):
    import random

    rng = random.Random(3)
    passage = prose_of(rng, 40)
    text = f"{prose_of(rng, 20)} {passage} {prose_of(rng, 10)} {passage} end"
    rows = [(9, text), (2, text), (1, "short"), (5, f"{prose_of(rng, 15)} {passage} {prose_of(rng, 15)}"), (7, text)]
    got = by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)))
    want = brute_repeats(sorted(rows))
    assert want[2][1] > 0 and want[5][1] > 0
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: w[:4] for i, w in want.items()}


def test_suffix_dedup_in_many_buckets(spark, docs, corpus, prose_of, monkeypatch):
    """More buckets than a batch may send messages, and a line that stands in most documents."""
    import random

    rng = random.Random(9)
    line = prose_of(rng, 40)
    rows = [(i, t) for i, t in corpus] + [(1000 + k, f"{prose_of(rng, 12)} {line} {prose_of(rng, 12)}" if k % 2 else f"{line}{line}") for k in range(40)]
    for name, value in {"BATCH": 3000, "BUCKET": 3000, "GROUPS": 3, "REGROUP": 50, "HOT_BYTES": 400, "FAN": 3}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    want = brute_repeats(rows)
    got = by_id(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: w[:4] for i, w in want.items()}


def test_deep_shallow_sorts():
    rng = np.random.default_rng(5)
    pool = [bytes(rng.integers(0, 3, size=rng.integers(0, 40), dtype=np.uint8)) for _ in range(300)]
    pool += [b"a" * 20 + p for p in pool[:100]] + [b"\xff" * 16 + p for p in pool[:50]] + [b"", b"\0", b"\0\0"] + pool[:40]
    rank, lcp = suffix_dedup.deep_shallow(pool)
    placed = [pool[k] for k in np.argsort(rank)]
    assert placed == sorted(pool)
    for k in range(1, len(placed)):
        a, b = placed[k - 1], placed[k]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_simhash(docs, empty, corpus):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: simhash.fingerprint(t) for i, t in corpus}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r.component_id for i, r in got.items()} == root
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(root.values())
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_shared_ids(spark, prose_of):
    import random

    rng = random.Random(11)
    a, b, c, d = (prose_of(rng, 60) for _ in range(4))
    rows = [(None, a, 1), (None, b, 2), (None, b, 2), (3, c, 3), (3, d, 4), (3, d, 4), (5, b, 5), (6, a + " ", 6), (None, None, 7), (None, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _n int").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert found == sorted([(6, a + " "), (5, b), (3, c), (3, d), (0, "")])


def test_posting_width():
    assert [simhash.width_for(n) for n in (1, 2000, 10**5, 10**7, 10**10)] == [1, 1, 2, 3, 4]
    assert simhash.Choices(4).first[0b11110000] == 0b11110000 and simhash.Choices(2).first[0b11110000] == 0b00110000 and simhash.Choices(2).first[0b111] == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_simhash_of_dense_groups(spark, width):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {p ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for p in base[:3] for _ in range(150)} | set(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp bigint").repartition(3), width).collect()]

    def groups(pairs):
        root = {p[0]: p[0] for p in signed}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(x for x in root if find(x) == r) for r in map(find, root)}

    mask = (1 << 64) - 1
    exact = [(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & mask).bit_count() <= 4]
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in found)
    assert groups(found) == groups(exact) and len(found) < len(exact)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


# filters


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, empty, corpus, prose_of):
    import random

    rng = random.Random(1)
    bad = [(1000 + k, " ".join(w + "%%%" for w in prose_of(rng, 80).split()) + "\nsame\nsame") for k in range(60)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(bad, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in corpus if i < 60] + [(i, 0, 0) for i, _ in bad[:40]] + [(5, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality.quality(rows, labels))
    for i, t in [*corpus, *bad]:
        n = counts(t)
        assert tuple(got[i])[1:6] == n
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert got[i].kept == (not got[i].base_failed and i < 1000)
    assert quality.quality(empty, labels).count() == 0
    none = quality.quality(docs, labels.where("1 = 0")).where("not base_failed")
    assert none.where("kept").count() == none.count() > 0
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, _ in corpus if got[i].kept}


def test_quality_of_held_out_labels(spark):
    """Fitted on half the labels, the rules agree with the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality.quality(docs, labels.where(~other)).join(labels.where(other).select("doc_id", "quality"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert len(got) > 50 and sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_toxicity_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in got if r.toxic == 0) <= 0.02 * len(got)
    brier = sum((r.score - r.toxic) ** 2 for r in got) / len(got)
    assert brier < 0.03


def test_samples_are_bounded_by_ids(spark, docs, corpus):
    """A labelled doc_id with very many rows is one document of the sample."""
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i, _ in corpus], "doc_id bigint, quality int, toxic int")
    rows = docs.select("doc_id", "text")
    many = rows.union(rows.where("doc_id = 1").crossJoin(spark.range(300)).select("doc_id", "text"))
    one, more = (quality.fit(x, labels) for x in (rows, many))
    assert np.array_equal(one[0], more[0]) and one[1:] == more[1:]
    one, more = (toxicity.fit(x, labels) for x in (rows, many))
    assert np.array_equal(one.scores, more.scores) and (one.slope, one.offset) == pytest.approx((more.slope, more.offset))


def test_decontamination(spark, docs, empty, corpus, prose_of):
    import random

    rng = random.Random(4)
    items = [(k, f"What of {prose_of(rng, 14)} {k}? It is qq{k} {prose_of(rng, 6)}") for k in range(40)] + [(90, None), (91, ""), (92, "too short"), (3, "What of?")]
    planted = [(500 + k, f"{prose_of(rng, 150)} {items[k][1].upper()} {prose_of(rng, 90)}") for k in range(10)]
    clean = [(600 + k, prose_of(rng, 300)) for k in range(10)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(planted + clean, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, t in [*corpus, *planted, *clean]:
        words = decontaminate.item_words(t)
        for item, text in items:
            w = decontaminate.item_words(text)
            width = min(5, len(w))
            held = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            if w and len(own & held) >= 0.8 * len(own):
                want.add((i, item))
    assert {(500 + k, 3) for k in range(10)} <= want  # "What of?" is held as its two words
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, bench).collect()}
    assert got == want >= {(500 + k, k) for k in range(10)}
    assert {r.doc_id for r in decontaminate.drop_leaks(rows, bench).collect()} == {i for i, _ in [*corpus, *planted, *clean]} - {i for i, _ in want}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("1 = 0")).count() == 0


def test_decontamination_of_common_terms(spark, prose_of, monkeypatch):
    import random

    rng = random.Random(12)
    copied = " ".join(f"same{k}" for k in range(12))
    pool = [f"low{k}" for k in range(9)]
    items = [(k, copied) for k in range(20)] + [(100 + k, " ".join(rng.sample(pool, 9))) for k in range(60)] + [(200 + k, f"{prose_of(rng, 12)} qq{k}") for k in range(20)]
    rows = [(k, f"{prose_of(rng, 80)} {dict(items)[i]} {prose_of(rng, 120)}") for k, i in enumerate([0, 100, 131, 159, 200])] + [(9, prose_of(rng, 200))]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, t in rows:
        words = decontaminate.item_words(t)
        held = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item, text in items:
            w = decontaminate.item_words(text)
            own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if len(own & held) >= 0.8 * len(own):
                want.add((i, item))
    assert want >= {(0, k) for k in range(20)} | {(1, 100), (2, 131), (3, 159), (4, 200)}
    for postings in (decontaminate.POSTINGS, 50):
        monkeypatch.setattr(decontaminate, "POSTINGS", postings)
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {9}


def exhaustive(items, held):
    """BM25 of every item against every passage, from the formula, over the item's score against itself."""
    words = [t.split() for _, t in items]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = collections.Counter(x for w in words for x in set(w))
    weight = lambda w, x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return [[sum(weight(w, x) for x in set(w) if x in p) / sum(weight(w, x) for x in set(w)) for w in words] for p in held]


@pytest.mark.parametrize("kind", ["random", "narrow", "templated", "repeated", "one"])
def test_decontamination_retrieves_every_item(monkeypatch, kind):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(decontaminate, "POSTINGS", 300)
    drawn = lambda vocabulary: " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(5, 15)) % vocabulary)
    texts = {
        "random": [drawn(300) for _ in range(150)], "narrow": [drawn(8) for _ in range(150)], "one": ["w1 w2 w3 w4 w5"],
        "templated": [f"which w1 of the w2 is w{k % 7} or w{k}" for k in range(100)], "repeated": ["w1 w2 w3 w4 w5 w6"] * 80 + [drawn(20) for _ in range(40)],
    }[kind]
    index = decontaminate.Index(list(enumerate(texts)))
    terms = list(index.terms)
    held = rng.random((40, len(terms))) < rng.choice([0.1, 0.5, 0.9], size=(40, 1))
    scores = exhaustive(list(enumerate(texts)), [{terms[t] for t in np.flatnonzero(h)} for h in held])
    got = {(p, i): s for p, item, s in zip(*(x.tolist() for x in index.retrieve(*np.nonzero(held)))) for i in index.ids[item]}
    assert got == pytest.approx({(p, i): s for p, row in enumerate(scores) for i, s in enumerate(row) if s >= decontaminate.THRESHOLD - 1e-9})


def test_decontamination_in_parts(spark, prose_of, monkeypatch):
    import random

    rng = random.Random(21)
    items = [(k, f"{prose_of(rng, 8 + 40 * (k % 4))} qq{k}") for k in range(30)] + [(k, "all the same words here") for k in range(30, 40)]
    rows = [(k, f"{prose_of(rng, 60)} {items[k][1]} {prose_of(rng, 30)}") for k in range(0, 40, 3)] + [(90, None), (91, ""), (0, prose_of(rng, 9))]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate.benchmarks, "__defaults__", (1500,))
    parts = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in parts] and {r[:2] for r in whole} >= {(k, k) for k in range(0, 30, 3)} | {(k, j) for k in (30, 33, 36, 39) for j in range(30, 40)}
    assert np.allclose([r[2:] for r in whole], [r[2:] for r in parts])


def best_segment(scores):
    return max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)


def brute_segments(scores, base=0):
    """All maximal segments by their definition: the best one, then those to its left and right."""
    if not len(scores) or max(scores) <= 0:
        return []
    spans = [(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    a, b = max(spans, key=lambda s: (round(sum(scores[s[0] : s[1]]), 9), s[0] - s[1], -s[0]))
    return brute_segments(scores[:a], base) + [(a + base, b + base)] + brute_segments(scores[b:], base + b)


def test_segments():
    rng = np.random.default_rng(9)
    for _ in range(60):
        scores = np.where(rng.random(25) < 0.6, -0.25, rng.normal(0.3, 1.5, 25).round(3))
        got = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores.tolist())
        assert max((s for _, _, s in got), default=0) == pytest.approx(max(0, best_segment(scores.tolist())))
    assert toxicity.segments(np.zeros(0)) == []


def test_toxicity(spark, docs, empty, prose_of):
    import random

    rng = random.Random(6)
    rows = []
    for k in range(400):
        words = prose_of(rng, 60).split()
        if k % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "Scum,", "rotten"]))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    got = by_id(toxicity.toxicity(table, labels))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert toxicity.toxicity(docs, labels).count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("toxic = 2")).agg(F.max("score")).first()[0] < 1e-6
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5001, ""), (None, "vile"), (5002, "calm words " * 20000 + "vile " * 30)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in toxicity.toxicity(table.union(odd), labels).where("doc_id is null or doc_id >= 5000").collect()}
    assert found[5000].score == found[5001].score and found[5000].n_passages == found[5001].n_passages == 0 and found[5002].predicted == 1 and None in found


def test_toxicity_model_by_hand(spark):
    """Odds, lambda, K and calibration against the formulas, word by word."""
    import math

    rows = [(k, "bad worse plain plain day" if k % 3 == 0 else "plain day night plain sky", int(k % 3 == 0)) for k in range(300)]
    rows = [(k, f"{t} w{k % 7}", y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(table, labels)
    n = {y: collections.Counter(w for _, t, z in rows if z == y for w in t.split()) for y in (0, 1)}
    total = {y: sum(c.values()) for y, c in n.items()}
    score = {}
    for w in n[0] | n[1]:
        prior = min(total.values()) * (n[0][w] + n[1][w]) / sum(total.values())
        a, b = n[1][w] + prior, n[0][w] + prior
        mass = [total[y] + min(total.values()) for y in (0, 1)]
        delta = math.log(a / (mass[1] - a)) - math.log(b / (mass[0] - b))
        score[w] = delta if abs(delta) / math.sqrt(1 / a + 1 / b) >= toxicity.SIGNIFICANT else toxicity.NEUTRAL
    assert {w: model.scores[toxicity.bucket(w)] for w in score} == pytest.approx(score)
    weight = {w: n[0][w] + min(total.values()) * (n[0][w] + n[1][w]) / sum(total.values()) for w in score}
    assert sum(weight[w] * math.exp(model.lam * s) for w, s in score.items()) / sum(weight.values()) == pytest.approx(1, abs=1e-6)
    best = [max(0, best_segment([score[w] for w in t.split()])) for _, t, y in rows if not y]
    sizes = [len(t.split()) for _, t, y in rows if not y]
    log_k = -np.mean(np.log(sizes)) - math.log(np.mean([math.exp(-model.lam * s) for s in best]))
    assert model.log_k == pytest.approx(min(0, log_k))
    got = by_id(toxicity.toxicity(table, labels))
    for i, t, y in rows:
        found = [s for *_, s in toxicity.segments(np.array([score[w] for w in t.split()]))]
        excess = [e for s in found if (e := model.lam * s - model.log_k - math.log(len(t.split()))) > -math.log(toxicity.MAX_EXPECTED)]
        assert got[i].evidence == pytest.approx(math.log1p(sum(excess)))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-model.slope * got[i].evidence - model.offset)))
        assert got[i].predicted == y

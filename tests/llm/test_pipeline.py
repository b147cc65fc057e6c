"""The five stages on the smallest tables, each against what it should do to its input."""

import corpus_pipeline
from casegrain.llm import decontaminate, quality, simhash
from casegrain.llm.common import read_table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, DIR, "documents").cache()
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    kept = {r.doc_id for r in quality.quality(docs, read_table(spark, DIR, "labels")).where("kept").collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, DIR).cache()
        rows = docs.collect()
        if name == "quality rules":
            assert {r.doc_id for r in rows} == kept and len(rows) < len(seen)
        elif name == "SimHash near-dedup":
            prints = {i: simhash.fingerprint(t) for i, t in seen.items()}
            now = {r.doc_id for r in rows}
            assert all(any((prints[i] ^ prints[j]).bit_count() <= 4 for j in now) for i in seen)
        elif name == "suffix-array dedup":
            held: set[bytes] = set()
            left = {}
            for i in sorted(seen):
                data = (seen[i] or "").encode()
                cover = bytearray(len(data))
                for k in range(len(data) - 99):
                    if data[k : k + 100] in held:
                        cover[k : k + 100] = b"\1" * 100
                    held.add(data[k : k + 100])
                left[i] = bytes(b for b, c in zip(data, cover) if not c).decode("utf-8", "ignore")
            assert {r.doc_id: r.text for r in rows} == left and all(r.n_chars == len(r.text) for r in rows)
        elif name == "benchmark decontamination":
            index = decontaminate.Benchmark([(r.item_id, r.text) for r in read_table(spark, DIR, "benchmark").collect()])
            import pyarrow as pa

            ids = list(seen)
            leaked = {ids[f[0]] for f in index.leaks(pa.array([seen[i] for i in ids]))}
            assert {r.doc_id for r in rows} == set(seen) - leaked
        else:
            assert {r.doc_id for r in rows} == set(seen)
            break
        assert docs.columns == columns
        seen = {r.doc_id: r.text for r in rows}


def test_stages_of_odd_rows(spark, prose_of):
    """Null and shared ids, null, empty and repeated texts, columns with the operators' names, and no rows."""
    import random

    rng = random.Random(5)
    story = [prose_of(rng, 90) + f" t{k} u{k} v{k}" for k in range(8)]
    texts = [(None, story[0]), (None, story[1]), (1, story[2]), (1, story[3]), (1, story[3]), (2, story[4]), (3, None), (4, ""), (None, None), (5, story[4] + " "), (6, story[5] + " " + story[6]), (7, story[7])]
    rows = [(i, t, "en", "s", len(t or ""), *"abcdefgh") for i, t in texts]
    clash = ", ".join(f"{c} string" for c in ("_id", "_own", "_sha", "_kept", "key_0", "own_0", "fp", "root"))
    table = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clash}").repartition(3).cache()
    kept = {"quality rules": 9, "SimHash near-dedup": 7, "suffix-array dedup": 7, "benchmark decontamination": 7}
    for docs, sizes in ((table, kept), (table.where("1 = 0"), dict.fromkeys(kept, 0))):
        columns = docs.columns
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, DIR).cache()
            if name not in sizes:
                break
            assert (name, docs.count(), docs.columns) == (name, sizes[name], columns)
        assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ({None, 1, 2, 6, 7} if sizes is kept else set())

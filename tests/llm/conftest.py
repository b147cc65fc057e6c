import random

import pytest

WORDS = "the of and to in that was thion erand ouble heat nder stren ingly thor éclair straße año reon andst wheth orious ment tion plea grund".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: ties, copies, near copies, shared passages, null, empty and a long text."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 20) for _ in range(6)]
    texts += [texts[3], texts[3], texts[5] + " more", shared, "", None, "   \n\t ", "ab", "x" * 400, "xy" * 300, "a\n\n  b▁c  d", prose(rng, 4000)]
    texts += [" ".join(w if k % 40 else "zzz" for k, w in enumerate(texts[8].split()))]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own."""
    rows = [(i, t, 1.5, "x", i % 3, *range(8)) for i, t in corpus]
    clash = ", ".join(f"{c} int" for c in ("_id", "_own", "_sha", "_kept", "key_0", "own_0", "rows", "n"))
    return spark.createDataFrame(rows, f"doc_id bigint, text string, h double, bucket string, uid int, {clash}").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def prose_of():
    return prose

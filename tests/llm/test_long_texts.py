"""Long texts and all hashes: toxicity holds a slice of a text and a run of the sample at a time, and its features are those of whole texts."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import toxicity


def peak(f) -> float:
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_slices_have_all_grams():
    rng = random.Random(3)
    place = np.zeros(toxicity.DIMS, np.int32)
    kept = np.random.default_rng(3).choice(toxicity.DIMS, 300_000, replace=False)
    place[kept] = np.arange(1, len(kept) + 1)
    texts = ["", "ab", *("".join(rng.choices("abcd ÜİΣσß日\n", k=rng.randint(0, 300))) for _ in range(60))]
    want = [np.concatenate(x) for x in zip(*[(d + i, f) for i, t in enumerate(texts) for d, f in [toxicity.grams([t], place)]], strict=True)]
    for chars in (5, 50, 1000):
        assert all(np.array_equal(a, b) for a, b in zip(toxicity.grams(texts, place, chars), want, strict=True))


def test_last_place():
    """An n-gram that hashes to the last place is a feature like any other."""
    import itertools

    every = np.arange(1, toxicity.DIMS + 1, dtype=np.int32)
    codes = np.array(list(itertools.product(range(97, 123), repeat=5)), np.uint32)[: 1 << 22]
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, 6):
        h = h * np.uint32(2654435761) + codes[:, n - 1] + np.uint32(n)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(12)
    word = "".join(map(chr, codes[np.flatnonzero(h == toxicity.DIMS - 1)[0]]))
    texts = ["some text", word, "other text", f"{word} again"]
    d, f = toxicity.grams(texts, every)
    assert d[f == toxicity.DIMS].tolist() == [1, 3] and f.min() >= 1
    model = toxicity.fit(texts, np.array([0, 1, 0, 1]), floor=0.0)
    assert model.score([word])[0] > 0.5 > model.score(["other text"])[0]


def test_memory_of_one_long_text():
    words = [f"w{i}x" for i in range(5000)]
    text = " ".join(random.Random(4).choices(words, k=1_300_000))
    place = np.zeros(toxicity.DIMS, np.int32)
    place[:4096] = np.arange(1, 4097)
    assert len(text) > 7_000_000 and peak(lambda: toxicity.grams([text], place)) < 100


def test_memory_of_the_fit():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(200)]
    labels = np.arange(200) % 4 == 0
    assert peak(lambda: toxicity.fit(texts, labels, floor=0.0, rounds=2)) < 150


def test_rows_of_the_stage_are_untouched(spark):
    """Large ids beside null ones, in any column, go through as they are."""
    ids = [2**60 + k for k in range(40)]
    rows = [(None if k == 7 else i, None if k == 3 else f"text {k} " + "zqx bad " * (k % 4 == 0), None if k % 2 else i + 1) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long")
    labels = spark.createDataFrame([(i, int(k % 4 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert sorted(map(repr, (tuple(r["row"]) for r in scored.select("row").collect()))) == sorted(map(repr, rows))
    assert scored.filter(F.col("score").isNull()).count() == 0

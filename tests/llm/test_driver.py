"""What the driver holds and does: queries for a few links, bytes for a fit."""

import random
import tracemalloc

import numpy as np

from tidelog.llm import near_dedup, toxicity


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Few links are joined by one task, more go by rounds until they are few; both find the same components."""
    rng = random.Random(11)
    for case in range(3):
        names = rng.sample(range(-(10**12), 10**12), 400)
        links = [(names[i], names[i + 1]) for i in range(149)] + [(names[150 + i], names[150 + rng.randrange(i)]) for i in range(1, 100)] + [(names[7], names[7]), (names[399], names[399])]
        links += [(names[rng.randrange(260, 390)], names[rng.randrange(260, 390)]) for _ in range(70)]
        rng.shuffle(links)
        links += [(b, a) for a, b in links[:20]] + links[:5]
        near = {i: {i} for link in links for i in link}
        for a, b in links:
            if near[a] is not near[b]:
                near[a] |= near[b]
                near |= dict.fromkeys(near[b], near[a])
        want = sorted((i, min(s)) for i, s in near.items())
        saved, before = [], near_dedup.save
        monkeypatch.setattr(near_dedup, "save", lambda df, tag, before=before, saved=saved: saved.append(tag) or before(df, tag))
        df = spark.createDataFrame(links, "a long, b long").repartition(3)
        assert sorted(map(tuple, near_dedup.components(df).select("id", "comp").collect())) == want
        assert saved == ["near-links", "near-labels"]
        if not case:
            for at_once in (0, 60):
                assert sorted(map(tuple, near_dedup.components(df, None, at_once).select("id", "comp").collect())) == want
        monkeypatch.undo()
    none = near_dedup.components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_fit_in_small_runs():
    """The driver counts n-grams some texts at a time."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=200)) + (" venomword slurword" if i % 3 == 0 else "") for i in range(900)]
    labels = np.array([i % 3 == 0 for i in range(900)], float)
    tracemalloc.start()
    model = toxicity.fit(texts, labels, rounds=20)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    got = model.score(["plain words only", "a venomword here"])
    assert got[0] < got[1] and peak < 80, (got, peak)

"""Licence inheritance against brute force on a tree with one directory that holds most of the files."""

import random

from tidelog.llm import licenses

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def test_hot_directory(spark):
    rng = random.Random(7)
    rows = [("hot/LICENSE", MIT), ("hot/a/b/COPYING.txt", APACHE), ("cold/licence.md", APACHE), ("other/LICENSE", "no notice")]
    rows += [(f"hot/f{i}.txt", "plain") for i in range(4000)]
    for i in range(2000):
        root = rng.choice(["hot", "hot/a/b", "cold", "other", "none", "hotter"])
        rows.append(("/".join([root, *rng.choices("abc", k=rng.randrange(4)), f"g{i}.txt"]), rng.choice(["plain", "plain", APACHE])))
    own = {MIT: "MIT", APACHE: "Apache-2.0"}
    given = {"hot": "MIT", "hot/a/b": "Apache-2.0", "cold": "Apache-2.0"}
    want = []
    for i, (path, text) in enumerate(rows):
        parts = path.split("/")[:-1]
        above = ["/".join(parts[:k]) for k in range(len(parts), 0, -1)]
        near = None if text in own else next((d for d in above if d in given), None)
        want.append((i, own.get(text), near, own.get(text) or given.get(near)))
    df = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string")
    got = licenses.scan_licenses(df, "path").select("doc_id", "own_license", "inherited_from", "license").collect()
    assert sorted(map(tuple, got)) == want


def by_windows(rows, by_content=True):
    """Every window of every template's length, and the nearest directory's licence."""
    import math
    import re
    from collections import Counter

    words = {k: re.findall(licenses.TERM, (t or "").lower()) for k, (_, t) in enumerate(rows)}
    df = Counter(t for w in words.values() for t in set(w))
    idf = lambda t: licenses.idf(df[t], len(rows))
    tpl = [(name, ts, {t: n * idf(t) for t, n in Counter(ts).items()}) for _, name, ts in licenses.templates()]
    own = {}
    for k, w in words.items():
        hits, starts, notice = [], set(), False
        for name, ts, x in tpl:
            length = math.sqrt(sum(v * v for v in x.values()))
            for at in range(max(0, len(w) - len(ts)) + 1 if w else 0):
                if not x.keys() & set(w[at : at + len(ts)]):
                    continue
                y = {t: n * idf(t) for t, n in Counter(w[at : at + len(ts)]).items()}
                score = round(sum(x.get(t, 0.0) * v for t, v in y.items()) / length / math.sqrt(sum(v * v for v in y.values())), 9)
                if score >= licenses.THRESHOLD:
                    hits.append((-score, name))
                    starts.add(at)
                    notice |= 2 * min(len(ts), len(w)) >= len(w)
        own[k] = (min(hits)[1] if hits else None, len(starts), notice)
    given = {}
    for k, (path, _) in enumerate(rows):
        if own[k][0] and path is not None and (re.search(licenses.LICENCE_FILE, path) or (by_content and own[k][2])):
            d = path.rsplit("/", 1)[0] if "/" in path else ""
            given[d] = min(given.get(d, "~"), own[k][0])
    out = []
    for k, (path, _) in enumerate(rows):
        near = None
        if own[k][0] is None and path is not None:
            parts = path.split("/")[:-1]
            near = next((d for d in ["/".join(parts[:n]) for n in range(len(parts), -1, -1)] if d in given), None)
        out.append((k, own[k][0], own[k][1], near, own[k][0] or given.get(near)))
    return out


def test_windows_and_inheritance(spark):
    """The query's rows on documents, and notices within other text, cut, changed and across lines."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(f"{r.source}/{r.doc_id}", r.text) for r in docs]
    rows += [("x/a", "Released under the MIT License. Copyright 2024 Jane Doe"), ("x/b", "plain words"), (None, "plain"), ("x/c", None), ("x/d", "")]
    rows += [("y/a", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'), ("y/b/c/d", "nothing")]
    rows += [("z/a", "You may reuse this page freely, it is " + "released under the\nMIT License " + "and more words follow here " * 30), ("z/b", "the MIT"), ("top", "Licensed under CC BY 4.0."), ("q/r", "no notice")]
    rows += [("s/a", "Released under the MIT License. Licensed under the BSD 3-Clause License."), ("s/b", "license " * 500), ("t/a", "released under MIT license"), ("t/LICENSE", "Licensed under CC BY-NC 4.0. " * 2 + "word " * 900)] * 2
    df = spark.createDataFrame([(k, t, p) for k, (p, t) in enumerate(rows)], "doc_id long, text string, path string").select("*", F.lit(1).alias("Text"), F.lit("c").alias("rid"), F.lit("c").alias("t"))
    got = sorted(map(tuple, licenses.scan_licenses(df, "path", by_content=True).select("doc_id", "own_license", "n_segments", "inherited_from", "license").collect()))
    want = by_windows(rows)
    assert got == want
    assert sum(r[3] is not None for r in want) >= 5 and {r[1] for r in want} >= {"MIT", "Apache-2.0", "CC-BY-4.0"}
    assert licenses.scan_licenses(df.limit(0), "path", by_content=True).count() == 0

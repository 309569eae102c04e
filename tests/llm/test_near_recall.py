"""Near-dedup's recall against brute force on a template family: pages at 0.70 of each other, and pairs of them at 0.852."""

import random

from tidelog.llm import near_dedup


def family(seed: int, pairs: int, single: int):
    rng, template = random.Random(seed), [f"t{i}" for i in range(165)]
    sets = []
    for p in range(pairs):
        own = [f"p{p}x{i}" for i in range(51)]  # 19 in both, 16 in each
        sets += [template + own[:35], template + own[:19] + own[35:]]
    sets += [template + [f"s{q}x{i}" for i in range(35)] for q in range(single)]
    rng.shuffle(sets)
    close = [(i, j) for j, b in enumerate(map(set, sets)) for i, a in enumerate(map(set, sets[:j])) if 100 * len(a & b) >= 85 * len(a | b)]
    return [(i, " ".join(w)) for i, w in enumerate(sets)], close


def share(spark, rows, close, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, width=1, **how).collect()}
    assert len(of) == len(rows) and len(set(of.values())) >= len(rows) - len(close)  # nothing else is joined
    return sum(of[i] == of[j] for i, j in close) / len(close)


def test_deep_trees(spark):
    rows, close = family(1, 100, 100)
    assert len(close) == 100 and share(spark, rows, close, small=16, depth=10, pivots=4) >= 0.97


def test_large_last_nodes(spark):
    rows, close = family(2, 40, 60)
    assert share(spark, rows, close, small=16, depth=1, pivots=4) >= 0.97


def brute(texts: dict, width: int = 3, percent: int = 85) -> dict:
    """Component of each document: links of all pairs that share a shingle, then a flood."""
    import re
    from collections import Counter, defaultdict

    sets, holds = {}, defaultdict(list)
    for i, t in sorted(texts.items()):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = defaultdict(set)
    for j, s in sets.items():
        both = Counter(i for g in s for i in holds[g])
        for i, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[i]) - n):
                links[i].add(j), links[j].add(i)
        for g in s:
            holds[g].append(j)
    out = {}
    for i in sets:  # ascending
        if i not in out:
            out[i], todo = i, [i]
            while todo:
                for k in links[todo.pop()] - out.keys():
                    out[k] = i
                    todo.append(k)
    return out


def test_recall_on_documents(spark):
    """Whole documents of sf0.001 at the query's parameters, with extra columns of the operator's own names."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    clash = docs.select("*", *[F.lit(None).cast("long").alias(c) for c in ("rid", "id", "n", "comp", "tree", "node", "digest", "Text", "size")])
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(clash).collect()}
    assert sum(a != b for a, b in want.items()) > 0
    print("recall of members outside their own name:", sum(got[i] == c for i, c in want.items() if c != i) / sum(c != i for i, c in want.items()))
    assert got == want


def test_one_large_group(spark):
    """1200 different texts, all at 0.886 of each other or more, are one component, and a lone text stays alone."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:194], *(f"x{i}y{k}" for k in range(6))])) for i in range(1200)] + [(1205, "other words only"), (1206, None), (1206, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup.near_groups(df, small=64, depth=2, pivots=8).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id < 1200} == {0} and sum(r.kept for r in found) == 4


def test_hot_group_does_not_branch(spark, monkeypatch):
    """A group of one component ends at its first node; a text that is near one member only is still found, and one near a lone text too."""
    words = [f"w{i}" for i in range(200)]
    sets = [[*words[:194], *(f"x{i}y{k}" for k in range(6))] for i in range(1200)]
    near = [*words[25:194], *(f"x7y{k}" for k in range(6))]  # 0.875 of text 7, less of the others: 169 of 206
    lone = [*words[:100], *(f"l{k}" for k in range(100))]  # in the group's nodes, but far from it
    rows = [(i, " ".join(s)) for i, s in enumerate([*sets, near, lone, [*lone[:-5], "other"]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    branched, before = [], near_dedup.branch
    monkeypatch.setattr(near_dedup, "branch", lambda rows: branched.append(rows.count()) or before(rows))
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, width=1, small=64, depth=3, pivots=8).collect()}
    assert {found[i] for i in range(1201)} == {0} and found[1201] == found[1202] == 1201
    assert sum(branched) == 0


def test_components_on_graphs(spark):
    """Paths in any order, stars, trees, loops, double and reversed links, given at once or in two parts, against a flood."""
    rng = random.Random(5)
    for case in range(6):
        names = rng.sample(range(10**12), 260) if case else list(range(260))
        links = [(names[i], names[i + 1]) for i in range(99)] + [(names[100 + i], names[100]) for i in range(40)] + [(names[150 + i], names[150 + rng.randrange(i)]) for i in range(1, 60)]
        links += [(names[rng.randrange(210, 260)], names[rng.randrange(210, 260)]) for _ in range(40)] + [(names[5], names[5])]
        rng.shuffle(links)
        links += [(b, a) for a, b in links[:20]] + links[:5]
        later = links[200:] + [(names[99], names[120]), (names[149], names[210])]  # between components, and to an id without links
        near = {i: {i} for i in {i for link in links + later for i in link}}
        for a, b in links + later:
            if near[a] is not near[b]:
                near[a] |= near[b]
                near |= dict.fromkeys(near[b], near[a])
        df = [spark.createDataFrame(part, "a long, b long") for part in (links + later, links[:200], later)]
        once = near_dedup.components(df[0])
        twice = near_dedup.components(df[2], near_dedup.components(df[1]))
        want = sorted((i, min(s)) for i, s in near.items())
        assert sorted(map(tuple, once.select("id", "comp").collect())) == want
        assert sorted(map(tuple, twice.select("id", "comp").collect())) == want


def test_links_are_read_once(spark, monkeypatch):
    """A large group's links are joined to components once: not by every call, and not both ways."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:190], *(f"x{i}y{k}" for k in range(6))])) for i in range(1200)]  # 0.94 of each other
    rows += [(1200 + i, " ".join([*(f"o{i // 2}y{k}" for k in range(60)), f"only{i}"])) for i in range(60)]  # pairs, which the first links don't show
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given, read, calls, before, components = [], [], [], near_dedup.save, near_dedup.components

    def save(df, tag):
        out = before(df, tag)
        if tag == "near-links":
            read.append(out.count())
        return out

    def counted(links, *label):
        given.append({tuple(r) for r in links.select("a", "b").collect()})
        calls.append(len(given[-1]))
        return components(links, *label)

    monkeypatch.setattr(near_dedup, "save", save)
    monkeypatch.setattr(near_dedup, "components", counted)
    found = near_dedup.near_groups(df, small=64, depth=2, pivots=8).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i < 1200 else i - i % 2 for i in range(1260)}
    assert len(calls) > 1 and sum(calls) == len(set().union(*given))  # no link in two calls
    assert sum(read) <= 1.2 * sum(calls), (read, calls)

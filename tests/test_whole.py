"""Queries over whole tables against brute force, on rows that a cut or folded input would leave out."""

from itertools import product

import pytest

from tidelog import catalog

#: (supplier, part, line number, quantity): none has both l_linenumber = 1 and l_quantity > 49, most keys are over 97.
LINES = [(1, 2, 2, 5.0), (2, 300, 3, 50.0), (300, 1, 1, 4.0), (300, 97, 4, 1.0), (97, 400, 2, 1.0), (1, 300, 1, 1.0), (1, 2, 5, 9.0), (40, 41, 2, 2.0), (41, 42, 2, 2.0), (300, 40, 1, 1.0), (41, 300, 6, 2.0), (50, 2, 1, 1.0)]
CUSTOMERS = 600


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(LINES, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.range(1, CUSTOMERS + 1).selectExpr("id AS c_custkey").write.parquet(f"{d}/customer.parquet")
    return d


def test_whole_relation(spark, folder):
    g = {(a, b) for a, b, _, _ in LINES}
    tc = set(g)
    while more := {(a, d) for a, b in tc for c, d in g if b == c} - tc:
        tc |= more
    free = {(a, b) for a, b in g if a <= 50}
    two = {(a, b, d) for (a, b), (c, d) in product(g, g) if b == c}
    want = {
        "tc_cycle": tc,
        "triangle": {(a, b, c) for a, b, c in two if (c, a) in g},
        "square": {(a, b, c, e) for a, b, c in two for d, e in g if c == d and (e, a) in g},
        "neg_idb": {(a, d) for (a, b), (c, d) in product(free, free) if b == c},
        "agg_filtered": {(a, sum(b for c, b in g if c == a and b >= 10), sum(c == a and b >= 10 for c, b in g)) for a, b in g if b >= 10},
        "core_antijoin": {(b, a) for a, b in g if b not in {c for c, _ in g}},
        "leap_intersect": {(a, b, c) for a, b, c in two if (a, c) in g},
        "literal_atom": {(b,) for a, b in g if a == 3},
    }
    for name, rows in want.items():
        got = [tuple(r) for r in catalog.queries()[name](spark, folder).collect()]
        assert (rows or name == "literal_atom") and len(got) == len(rows) and set(got) == rows, name


def test_whole_same_generation(spark, folder):
    # the tree of c -> c div 2: ids from 2 of one bit length are of one generation
    got = {tuple(r) for r in catalog.queries()["same_generation"](spark, folder).collect()}
    ids = range(2, CUSTOMERS + 1)
    assert got == {(a, b) for a in ids for b in ids if a.bit_length() == b.bit_length()}


def test_same_generation_writes_no_pairs(spark, tmp_path, monkeypatch):
    """A forest with gaps: the pairs of the rules, of which none is written before the result; groups of more than one piece."""
    from tidelog.engine import Engine
    from tidelog.operators import relation
    from tidelog.plans.ir import variables
    from tidelog.sources import tables

    keys = [c for c in range(0, 90) if c not in (1, 2, 7, 9, 33, 40)] + [88]
    spark.createDataFrame([(c,) for c in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    x, y, z, w = variables("x y z w")
    e = Engine(spark)
    r, o = e.relation("r", "a bigint, b bigint", catalog.hier(spark, str(tmp_path))), e.relation("o", "a bigint, b bigint")
    e.rule(o(x, y), r(x, z), r(y, z)).rule(o(x, y), r(x, z), o(z, w), r(y, w)).solve()
    want, most = sorted(map(tuple, o.df().collect())), [0]

    def counted(df):
        out, n = tables.materialise(df)
        most[0] = max(most[0], n)
        return out, n

    monkeypatch.setattr(relation, "materialise", counted)
    monkeypatch.setattr(catalog, "materialise", counted)
    assert sorted(map(tuple, catalog.queries()["same_generation"](spark, str(tmp_path)).collect())) == want and 0 < most[0] <= len(keys)
    spark.range(1, 2500).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/more/customer.parquet")
    got = catalog.queries()["same_generation"](spark, f"{tmp_path}/more")
    ids = [sum(1 for i in range(2, 2500) if i.bit_length() == b) for b in range(2, 13)]
    assert got.count() == got.distinct().count() == sum(n * n for n in ids)


def test_two_variables_derive_a_pair_once(spark, folder, monkeypatch):
    """A tree's pairs are derived once each, not for each node on the way; graphs with loops and ways of several lengths give their closure."""
    from tidelog.operators import core

    made, helper = [0], core.join_helper

    def counted(*args):
        out = helper(*args)
        made[0] += out.count()
        return out

    monkeypatch.setattr(core, "join_helper", counted)
    got = [tuple(r) for r in catalog.queries()["core_two_variables"](spark, folder).collect()]
    want = {(a, a >> i) for a in range(2, CUSTOMERS + 1) for i in range(1, a.bit_length())}
    assert len(got) == len(want) and set(got) == want
    powers = sum(i in (2, 4, 8) for a in range(2, CUSTOMERS + 1) for i in range(1, a.bit_length()))
    assert made[0] <= len(want) + powers
    monkeypatch.setattr(core, "join_helper", helper)
    for edges in ({(i, (i + 1) % 7) for i in range(7)} | {(2, 5), (5, 9), (9, 10), (9, 9)}, {(i, i + 1) for i in range(11)} | {(0, 2), (2, 5), (4, 9), (11, 3)}, {(1, 1)}, set()):
        monkeypatch.setattr(catalog, "hier", lambda s, d, edges=edges: s.createDataFrame(sorted(edges) * 2, "a long, b long"))
        tc = set(edges)
        while more := {(a, d) for a, b in tc for c, d in edges if b == c} - tc:
            tc |= more
        got = [tuple(r) for r in catalog.queries()["core_two_variables"](spark, folder).collect()]
        assert len(got) == len(tc) and set(got) == tc

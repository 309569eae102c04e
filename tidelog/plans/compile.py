"""From a rule and a DataFrame for each of its atoms to a lazy DataFrame of bindings.

Every occurrence of a relation gets column names of its own, so Catalyst never sees one attribute twice. Tests and
negations are placed as soon as their variables are bound; variables that nothing above needs are dropped, but not under
an aggregate, which counts the distinct bindings of all variables.

A body whose atoms form a cycle isn't joined atom by atom, which would make all paths before the cycle closes, but variable by
variable: of the atoms that hold the next one, the one with fewest values for a row proposes them and the others check. So a hub
costs what the smaller side has, and no intermediate result outgrows the worst case of the whole body.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.extend import extended
from tidelog.plans.ir import WILD, Agg, Atom, Cmp, Rule, Var
from tidelog.sources.tables import materialise

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
_AGGS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}

#: Rows of a relation from which a cyclic body's atoms are reduced first, and from which a last join's fresh values go in lists.
REDUCED_FROM, LISTS_FROM = 100_000, 1_000_000


def _v(name: str) -> str:
    return f"v_{name}"


def atom_frame(atom: Atom, df: DataFrame, tag: str) -> DataFrame:
    """The atom's variables as columns ``<tag>_<variable>``, constants and repeated variables applied."""
    df = df.toDF(*[f"{tag}_c{i}" for i in range(len(df.columns))])
    keep: dict[str, str] = {}
    for i, a in enumerate(atom.args):
        c = f"{tag}_c{i}"
        if isinstance(a, Var):
            if a.name in keep:
                df = df.filter(F.col(c) == F.col(keep[a.name]))
            else:
                keep[a.name] = c
        elif a is not WILD:
            df = df.filter(F.col(c) == F.lit(a))
    return df.select(*[F.col(c).alias(f"{tag}_{n}") for n, c in keep.items()])


def order_atoms(rule: Rule, first: int | None, counts: list[int | None]) -> list[int]:
    """From ``first`` (or the smallest) on, always an atom that shares variables, the smaller first."""
    size = lambda i: counts[i] if counts[i] is not None else 1 << 60
    left = list(range(len(rule.atoms)))
    start = first if first is not None else min(left, key=size)
    order, bound = [start], set(rule.atoms[start].vars())
    left.remove(start)
    while left:
        key = lambda i: (not (set(rule.atoms[i].vars()) & bound), -len(set(rule.atoms[i].vars()) & bound), size(i))
        i = min(left, key=key)
        order.append(i)
        bound |= set(rule.atoms[i].vars())
        left.remove(i)
    return order


def is_cyclic(atoms: tuple[Atom, ...]) -> bool:
    """Whether no order of ears takes the body apart (an ear: its shared variables all lie in one other atom)."""
    left = [set(a.vars()) for a in atoms]
    while len(left) > 1:
        for i, own in enumerate(left):
            rest = left[:i] + left[i + 1 :]
            shared = own & set().union(*rest)
            if any(shared <= other for other in rest):
                left = rest
                break
        else:
            return True
    return False


def _next_variable(atoms, bound: set[str]) -> str:
    """The variable that most atoms with a bound one hold; the first of them."""
    free = list(dict.fromkeys(v for a in atoms for v in a.vars() if v not in bound))
    return max(free, key=lambda v: (sum(v in a.vars() and bool(set(a.vars()) & bound) for a in atoms), -free.index(v)))


def _reduced(rule: Rule, frames: list[DataFrame], counts: list[int | None]) -> list[DataFrame]:
    """Each atom's facts whose values the other atoms with the same variable have too, as often as that halves any of them. What it
    leaves out is in no binding, but would be in the bindings of some of the variables, which outgrow the facts."""
    at = [{n: next(j for j, x in enumerate(a.args) if isinstance(x, Var) and x.name == n) for n in a.vars()} for a in rule.atoms]
    while True:
        made: dict = {}  # atoms over one frame with the same needs share one
        keys = []
        for i, own in enumerate(at):
            others = [(c, j, at[j][n]) for n, c in own.items() for j in range(len(at)) if j != i and n in at[j]]
            needs = {(c, id(frames[j]), k): j for c, j, k in others if (frames[j] is not frames[i] or c != k)}
            keys.append((id(frames[i]), frozenset(needs)))
            if keys[-1] in made:
                continue
            df = frames[i].toDF(*[f"c{c}" for c in range(len(frames[i].columns))])
            for m, ((c, _, k), j) in enumerate(needs.items()):
                values = frames[j].toDF(*[f"d{c}" for c in range(len(frames[j].columns))]).select(F.col(f"d{k}").alias(f"m{m}")).distinct()
                df = df.join(values, F.col(f"c{c}") == F.col(f"m{m}"), "left_semi")
            made[keys[-1]] = materialise(df.toDF(*frames[i].columns))
        now = [made[k][1] for k in keys]
        fell = any(c is None or 2 * n < c for n, c in zip(now, counts, strict=True))
        frames, counts = [made[k][0] for k in keys], now
        if not fell or not min(now):
            return frames


def _by_variable(rule: Rule, frames: list[DataFrame], start: int, reduced: bool):
    """Yields the bindings so far and the variables bound, first of atom ``start``, then with one variable more each time.
    ``reduced``: an atom proposes no value that another one lacks."""
    first = atom_frame(rule.atoms[start], frames[start], "a")
    bound = set(rule.atoms[start].vars())
    out = yield first.select(*[F.col(f"a_{n}").alias(_v(n)) for n in sorted(bound)]), set(bound)
    others = [(a, atom_frame(a, f, "x")) for i, (a, f) in enumerate(zip(rule.atoms, frames, strict=True)) if i != start]
    for a, df in others:
        if set(a.vars()) <= bound:
            out = out.join(df, reduce(operator.and_, [F.col(_v(n)) == F.col(f"x_{n}") for n in a.vars()]), "left_semi")
    while free := {v for a in rule.atoms for v in a.vars()} - bound:
        v = _next_variable(rule.atoms, bound)
        extenders, alone = [], []
        reduced = reduced and any(v in a.vars() and set(a.vars()) & bound for a, _ in others)
        for a, df in others:
            keys = [n for n in a.vars() if n in bound]
            if v in a.vars():
                values = df.select(*[F.col(f"x_{n}") for n in (*keys, v)])
                values = values if set(a.vars()) <= bound | {v} else values.distinct()
                if reduced and not keys and len(a.vars()) > 1:
                    continue
                (extenders if keys else alone).append((values, [_v(n) for n in keys], [f"x_{n}" for n in keys], f"x_{v}"))
        out = extended(out, _v(v), extenders or alone[:1])
        for values, _, _, x in alone if extenders else alone[1:]:
            out = out.join(values, F.col(_v(v)) == F.col(x), "left_semi")
        bound |= {v}
        out = yield out, set(bound)
        if not free - {v}:
            return


def _test(t) -> Column:
    if isinstance(t, Cmp):
        side = lambda a: F.col(_v(a.name)) if isinstance(a, Var) else F.lit(a)
        return _OPS[t.op](side(t.left), side(t.right))
    return t.test(*[F.col(_v(a.name)) for a in t.args])


def binds_once(rule: Rule) -> bool:
    """Whether sets of facts give each binding of all variables once: nothing of a fact is left out, and equal means the same (one type)."""
    kinds: dict[str, set] = {}
    for a in rule.atoms:
        for x, f in zip(a.args, a.relation.schema.fields, strict=True):
            if isinstance(x, Var):
                kinds.setdefault(x.name, set()).add(f.dataType.simpleString())
            elif x is WILD or isinstance(x, bool) or not (isinstance(x, int) and isinstance(f.dataType, T.IntegralType)):
                return False
    return all(a.vars() for a in rule.atoms) and all(len(k) == 1 for k in kinds.values())


def heads_once(rule: Rule, head: Atom) -> bool:
    """Whether sets of facts give each row of ``head`` once: it holds all variables, in their types."""
    if rule.aggs or not binds_once(rule):
        return False
    kinds = {x.name: f.dataType for a in rule.atoms for x, f in zip(a.args, a.relation.schema.fields, strict=True) if isinstance(x, Var)}
    held = {x.name for x, f in zip(head.args, head.relation.schema.fields, strict=True) if isinstance(x, Var) and kinds.get(x.name) == f.dataType}
    return held == set(kinds)


def bindings(rule: Rule, frames: list[DataFrame], negated: list[DataFrame], first: int | None = None, counts: list[int | None] | None = None) -> DataFrame:
    """The rule's bindings as columns ``v_<variable>`` (not distinct)."""
    order = order_atoms(rule, first, counts or [None] * len(frames))
    tests, nots = list(rule.tests), list(enumerate(rule.nots))

    def checked(out: DataFrame, bound: set[str]) -> DataFrame:
        for t in [t for t in tests if set(t.vars()) <= bound]:
            out = out.filter(_test(t))
            tests.remove(t)
        for j, n in [x for x in nots if set(x[1].atom.vars()) <= bound]:
            no = atom_frame(n.atom, negated[j], f"n{j}")
            names = n.atom.vars()
            if names:
                on = reduce(operator.and_, [F.col(_v(x)) == F.col(f"n{j}_{x}") for x in names])
                out = out.join(no, on, "left_anti")
            else:
                out = out.join(no.limit(1).select(F.lit(1).alias(f"n{j}_")), F.lit(True), "left_anti")
            nots.remove((j, n))
        return out

    if all(a.vars() for a in rule.atoms) and is_cyclic(rule.atoms):
        reduced = max([c or 0 for c in counts or [0]]) >= REDUCED_FROM
        if reduced:
            frames = _reduced(rule, frames, counts if first is None else [None if i == first else c for i, c in enumerate(counts)])
        steps = _by_variable(rule, frames, order[0], reduced)
        out, bound = next(steps)
        while True:
            out = checked(out, bound)
            try:
                out, bound = steps.send(out)
            except StopIteration:
                return grouped(rule.aggs, out, binds_once(rule)) if rule.aggs else out
    out: DataFrame | None = None
    bound: set[str] = set()
    for k, i in enumerate(order):
        atom, tag = rule.atoms[i], f"a{k}"
        df = atom_frame(atom, frames[i], tag)
        own = atom.vars()
        shared = [n for n in own if n in bound]
        fresh = [n for n in own if n not in bound]
        if out is None:
            out = df.select(*[F.col(f"{tag}_{n}").alias(_v(n)) for n in own]) if own else df.limit(1).select(F.lit(1).alias("v_"))
        elif not own:
            out = out.crossJoin(df.limit(1).select(F.lit(1).alias(f"{tag}_")))  # a test: is there any such fact
            out = out.drop(f"{tag}_")
        elif not shared:
            out = out.crossJoin(df).select(*[_v(n) for n in sorted(bound)], *[F.col(f"{tag}_{n}").alias(_v(n)) for n in fresh])
        else:
            on = reduce(operator.and_, [F.col(_v(n)) == F.col(f"{tag}_{n}") for n in shared])
            if fresh and k == len(order) - 1 and k and _in_lists(rule, order, tests, nots, shared, fresh, first, counts):
                heads = {v for h in rule.heads for v in h.vars()}
                out = _by_lists(out, df, on, [v for v in sorted(bound) if v in heads], [f"{tag}_{n}" for n in shared], {f"{tag}_{n}": _v(n) for n in fresh if n in heads})
                own, bound = [n for n in fresh if n in heads], bound & heads
            elif fresh:
                out = out.join(df, on).select(*[_v(n) for n in sorted(bound)], *[F.col(f"{tag}_{n}").alias(_v(n)) for n in fresh])
            else:
                out = out.join(df, on, "left_semi")
        bound |= set(own)
        out = checked(out, bound)
        if not rule.aggs:
            later = {v for x in order[k + 1 :] for v in rule.atoms[x].vars()} | {v for t in tests for v in t.vars()}
            later |= {v for _, n in nots for v in n.atom.vars()} | {v for h in rule.heads for v in h.vars()}
            if bound - later and bound & later:
                bound &= later
                out = out.select(*[_v(n) for n in sorted(bound)])
    return grouped(rule.aggs, out, binds_once(rule)) if rule.aggs else out


def _in_lists(rule: Rule, order: list[int], tests: list, nots: list, shared: list[str], fresh: list[str], first: int | None, counts: list[int | None] | None) -> bool:
    """Whether the last join of a large body leaves variables out, so that its rows are made distinct, and all that is left to do is on the head's."""
    head = set(rule.heads[0].vars())
    later = {v for t in tests for v in t.vars()} | {v for _, n in nots for v in n.atom.vars()}
    if first is not None or rule.aggs or len(rule.heads) > 1 or min(c or 0 for c in counts or [0]) < LISTS_FROM:
        return False
    return bool(head & set(fresh) and head - set(fresh) and set(shared) - head and later <= head)


def _by_lists(left: DataFrame, right: DataFrame, on: Column, kept: list[str], keys: list[str], fresh: dict[str, str]) -> DataFrame:
    """``left`` joined with ``right``'s fresh values, dealt out by what is kept of ``left``: the values go in lists (of about 4096 at
    most), and equal rows come together before they are taken out of them."""
    piece = F.pmod(F.xxhash64(*fresh), F.expr("in_group div 4096 + 1"))
    lists = right.withColumn("in_group", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("in_piece", piece)
    row = F.struct(*[F.col(c).alias(n) for c, n in fresh.items()])
    if len(fresh) > 1:
        values = F.collect_list(row)
    else:  # a list of bare values is shorter; nulls, which it leaves out, are added
        c = next(iter(fresh))
        nulls = F.array_repeat(F.lit(None).cast(right.schema[c].dataType), F.count_if(F.col(c).isNull()).cast("int"))
        values = F.concat(F.collect_list(c), nulls)
    lists = lists.groupBy(*keys, "in_piece").agg(values.alias("in_values"))
    out = left.join(lists, on).select(*[_v(n) for n in kept], "in_values").repartition(*[_v(n) for n in kept])
    out = out.select(*[_v(n) for n in kept], F.explode("in_values").alias("in_value"))
    return out.select(*[_v(n) for n in kept], *[F.col(f"in_value.{n}" if len(fresh) > 1 else "in_value").alias(n) for n in fresh.values()])


def _reducer(fn: Callable) -> Callable:
    import pandas as pd

    def reducer(s):
        return fn(s)

    reducer.__annotations__ = {"s": pd.Series, "return": float}
    return reducer


def grouped(aggs: tuple[Agg, ...], df: DataFrame, once: bool = False) -> DataFrame:
    """Built-in aggregates are combined before the shuffle; a function of one's own gets each group whole, a global one
    the whole input in one task. Where a rule has both kinds they are computed apart and joined on the groups. ``once``: no two rows of ``df`` are equal."""
    df = df if once else df.distinct()
    by = [_v(v.name) for v in aggs[0].by]
    kinds = [[a for a in aggs if isinstance(a.fn, str)], [a for a in aggs if not isinstance(a.fn, str)]]
    frames = [_one_kind(own, by, df) for own in kinds if own]
    if len(frames) == 1:
        return frames[0]
    left, right = frames
    if not by:
        return left.crossJoin(right)  # a row each
    right = right.withColumnsRenamed({c: f"g_{c}" for c in by})
    on = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in by])
    return left.join(right, on).drop(*[f"g_{c}" for c in by])


def _one_kind(aggs: list[Agg], by: list[str], df: DataFrame) -> DataFrame:
    builtin = isinstance(aggs[0].fn, str)
    call = lambda a: _AGGS[a.fn] if builtin else F.pandas_udf(_reducer(a.fn), a.returns)
    cols = [call(a)(F.col(_v(a.value.name))).alias(_v(a.out.name)) for a in aggs]
    if by:
        return df.groupBy(*by).agg(*cols)
    if builtin:
        return df.groupBy().agg(*cols, F.count(F.lit(1)).alias("v_rows")).filter("v_rows > 0").drop("v_rows")
    return df.groupBy(F.lit(0).alias("v_all")).agg(*cols).drop("v_all")


def project(head: Atom, df: DataFrame) -> DataFrame:
    """The head's rows, with the relation's column names and types."""
    cols = []
    for a, f in zip(head.args, head.relation.schema.fields, strict=True):
        c = F.col(_v(a.name)) if isinstance(a, Var) else F.lit(a)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)

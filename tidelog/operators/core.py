"""Hand-written fixpoints: variables in three generations, delta joins, anti-joins, and extensions of a source.

    it = Iteration(spark)
    path = it.variable("path", "k bigint, v bigint").insert(edges)
    while it.changed():
        path.from_join(path, edge, lambda k, v1, v2: (v1, v2))
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.extend import Extender, extended
from tidelog.operators.relation import union, without
from tidelog.sources.tables import few_sent, leaves_stay, materialise, table_path


def join_helper(left: DataFrame, right: DataFrame, logic: Callable[..., tuple], keys: int = 1) -> DataFrame:
    """``logic(key.., left values.., right values..)`` of all pairs with equal leading ``keys`` columns."""
    a = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    b = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    on = reduce(operator.and_, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(keys)])
    args = [F.col(c) for c in a.columns] + [F.col(c) for c in b.columns[keys:]]
    return _rows(a.join(b, on), logic(*args))


def _rows(df: DataFrame, out) -> DataFrame:
    """``out``: a tuple of Columns, or (condition, tuple) to keep only some rows."""
    if isinstance(out, tuple) and len(out) == 2 and isinstance(out[1], tuple):
        df, out = df.filter(out[0]), out[1]
    out = out if isinstance(out, tuple) else (out,)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(out)])


def _keeps(out, cols: list[Column]) -> bool:
    """Whether ``out`` holds each of ``cols`` as it is, so that different rows stay different."""
    out = out[1] if isinstance(out, tuple) and len(out) == 2 and isinstance(out[1], tuple) else out
    out = out if isinstance(out, tuple) else (out,)
    return all(any(o is c for o in out) for c in cols)


def _only_filters(rows: DataFrame, source: DataFrame) -> bool:
    """Whether ``rows`` are those of ``source`` that pass tests, as far as the plan shows it."""
    plan, end = rows._jdf.queryExecution().analyzed(), source._jdf.queryExecution().analyzed()
    while not plan.equals(end):
        if plan.nodeName() != "Filter":
            return False
        plan = plan.child()
    return True


def antijoin(left: DataFrame, right: DataFrame, logic: Callable[..., tuple] | None = None) -> DataFrame:
    """Rows of ``left`` whose leading columns aren't a row of ``right``."""
    a = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    b = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    on = reduce(operator.and_, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(b.columns))])
    kept = a.join(b, on, "left_anti")
    return _rows(kept, logic(*[F.col(c) for c in kept.columns]) if logic else tuple(F.col(c) for c in kept.columns))


class Variable:
    """A growing set: ``stable`` facts, those new in this round (``recent``) and those to come. With ``distinct=False``
    what comes in isn't compared with what is stable.

    What comes in first as a set of large tables' rows extended by values is written when something reads it as stable or recent, not
    before: a result that only :meth:`facts` asks for may be many times its input, and is made where it is used."""

    def __init__(self, spark: SparkSession, name: str, schema: str, distinct: bool = True):
        self.spark, self.name, self.distinct = spark, name, distinct
        self.empty = spark.createDataFrame([], schema)
        self.parts: list[DataFrame] = []
        self._recent: DataFrame | None = None
        #: The first facts while they aren't written, and whether they are recent.
        self.unwritten: DataFrame | None = None
        self.unwritten_recent = False
        self.pending: list[DataFrame] = []
        #: Whether what is pending is one frame without equal rows, and one that may wait to be written.
        self.pending_is_set = self.pending_waits = False

    def insert(self, rows, distinct: bool = False) -> Variable:
        """``distinct``: no two of ``rows`` are equal."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], self.empty.schema)
        fields = self.empty.schema.fields
        own = rows.toDF(*[f.name for f in fields]).select(*[F.col(f.name).cast(f.dataType) for f in fields])
        if distinct and [f.dataType for f in rows.schema.fields] == [f.dataType for f in fields]:
            own._facts_path = table_path(rows)
            return self._add(own, True, table_path(rows) is not None)
        return self._add(own)

    extend = insert

    def _add(self, rows: DataFrame, is_set: bool = False, waits: bool = False) -> Variable:
        self.pending_is_set = is_set and not self.pending
        self.pending_waits = self.pending_is_set and waits
        self.pending.append(rows)
        return self

    def _write(self) -> None:
        if self.unwritten is None:
            return
        rows, self.unwritten = self.unwritten, None
        if table_path(rows):
            part, n = rows, not rows.isEmpty()
        else:
            with few_sent(self.spark):
                part, n = materialise(rows)
        if n and self.unwritten_recent:
            self._recent = part
        elif n:
            self.parts.append(part)

    @property
    def recent_part(self) -> DataFrame | None:
        self._write()
        return self._recent

    def stable(self) -> DataFrame:
        self._write()
        return union(self.parts) if self.parts else self.empty

    def recent(self) -> DataFrame:
        return self.empty if self.recent_part is None else self.recent_part

    def total(self) -> DataFrame:
        return self.stable().union(self.recent())

    def changed(self) -> bool:
        """Recent facts become stable, pending ones recent; true if there are any, or may be some that aren't written yet."""
        if self._recent is not None:
            self.parts.append(self._recent)
            if len(self.parts) > 8:
                self.parts = [materialise(self.stable().distinct())[0]]
        new, self.pending = union(self.pending), []
        self._recent, self.unwritten_recent = None, False
        if new is not None and self.pending_waits and self.unwritten is None and not self.parts:
            self.unwritten, self.unwritten_recent = new, True
        elif new is not None:
            new = new if self.pending_is_set else new.distinct()
            if self.distinct and (self.unwritten is not None or self.parts):
                new = without(new, self.stable())
            with few_sent(self.spark):
                part, n = materialise(new)
            self._recent = part if n else None
        return self._recent is not None or self.unwritten_recent

    def complete(self) -> DataFrame:
        """All facts in order, once nothing is recent or pending."""
        return self.facts().orderBy(*self.empty.columns)

    def facts(self) -> DataFrame:
        """All facts in any order, which takes no shuffle; once nothing is recent or pending."""
        if self.pending or self._recent is not None or self.unwritten is not None and self.unwritten_recent:
            raise RuntimeError(f"{self.name} isn't stable")
        if self.unwritten is not None and not self.parts:
            return self.unwritten
        return self.stable() if self.distinct or len(self.parts) == 1 else self.stable().distinct()

    def from_join(self, left: Variable | DataFrame, right: Variable | DataFrame, logic: Callable[..., tuple], keys: int = 1) -> Variable:
        """Insert ``logic`` of the pairs with a recent side (a DataFrame is stable). ``logic`` may return (condition, row)."""
        ls, lr = (left.stable(), left.recent_part) if isinstance(left, Variable) else (left, None)
        rs, rr = (right.stable(), right.recent_part) if isinstance(right, Variable) else (right, None)
        for a, b in ((lr, rs), (ls, rr), (lr, rr)):
            if a is not None and b is not None:
                self._add(join_helper(a, b, logic, keys).toDF(*self.empty.columns))
        return self

    from_join_filtered = from_join

    def from_antijoin(self, source: Variable, right: DataFrame, logic: Callable[..., tuple] | None = None) -> Variable:
        if source.recent_part is None:  # else all that is stable would be dealt out to be compared with nothing
            return self
        return self._add(antijoin(source.recent(), right, logic).toDF(*self.empty.columns), logic is None)

    def from_map(self, source: Variable, logic: Callable[..., tuple]) -> Variable:
        if source.recent_part is None:
            return self
        df = source.recent()
        cols = [F.col(c) for c in df.columns]
        out = logic(*cols)
        return self._add(_rows(df, out).toDF(*self.empty.columns), _keeps(out, cols))

    def from_leapjoin(self, source: Variable, leapers: list, logic: Callable[..., tuple]) -> Variable:
        if source.recent_part is None:
            return self
        rows, is_set = _leapt(source.recent(), leapers, logic)
        once = sum(isinstance(x, (ExtendWith, ExtendAnti)) for x in leapers) == 1  # checks of values are laid out as they are written
        return self._add(rows.toDF(*self.empty.columns), is_set, once and leaves_stay(rows))


class Iteration:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.variables: list[Variable] = []

    def variable(self, name: str, schema: str) -> Variable:
        self.variables.append(Variable(self.spark, name, schema))
        return self.variables[-1]

    def variable_indistinct(self, name: str, schema: str) -> Variable:
        self.variables.append(Variable(self.spark, name, schema, distinct=False))
        return self.variables[-1]

    def changed(self) -> bool:
        return any([v.changed() for v in self.variables])  # every variable steps


class Leaper:
    """A step of a leapjoin. ``keys``: from the source's columns to the key; the relation has key columns, then the value."""

    def __init__(self, df: DataFrame | None = None, keys: Callable[..., tuple] | None = None, test: Callable[..., Column] | None = None):
        self.df, self.keys, self.test = df, keys, test

    def _joined(self, s: DataFrame, n: int, how: str) -> DataFrame:
        ks = self.keys(*[F.col(f"s{i}") for i in range(n)])
        ks = ks if isinstance(ks, tuple) else (ks,)
        r = self.df.toDF(*[f"r{i}" for i in range(len(self.df.columns))])
        return s.join(r, reduce(operator.and_, [k == F.col(f"r{i}") for i, k in enumerate(ks)]), how)

    def extender(self, n: int, tag: str) -> Extender:
        keys = self.keys(*[F.col(f"s{i}") for i in range(n)])
        keys = list(keys) if isinstance(keys, tuple) else [keys]
        names = [f"{tag}{i}" for i in range(len(self.df.columns))]
        return self.df.toDF(*names), keys, names[: len(keys)], names[len(keys)]


class ExtendWith(Leaper):
    """Values under the source's key: proposes, or keeps those proposed that are present. ``distinct``: no two rows of ``df`` are equal."""

    def __init__(self, df: DataFrame, keys: Callable[..., tuple], distinct: bool = False):
        super().__init__(df, keys)
        self.distinct = distinct

    def one_row_a_value(self, s: DataFrame, n: int) -> bool:
        """Whether a row is joined with each value once: no equal rows, none that differ only in columns after the value or by types."""
        keys = self.keys(*[F.col(f"s{i}") for i in range(n)])
        kinds = [f.dataType for f in s.select(*(keys if isinstance(keys, tuple) else (keys,))).schema.fields]
        own = [f.dataType for f in self.df.schema.fields]
        return self.distinct and len(own) == len(kinds) + 1 and own[:-1] == kinds


class ExtendAnti(Leaper):
    """Drops proposed values that are present under the key."""


class FilterWith(Leaper):
    """Keeps source rows whose key (of all the relation's columns) is present."""

    def apply(self, s: DataFrame, n: int) -> DataFrame:
        return self._joined(s, n, "left_semi")


class FilterAnti(Leaper):
    def apply(self, s: DataFrame, n: int) -> DataFrame:
        return self._joined(s, n, "left_anti")


class PrefixFilter(Leaper):
    """Keeps source rows that pass ``test``."""

    def __init__(self, test):
        super().__init__(test=test)

    def apply(self, s: DataFrame, n: int) -> DataFrame:
        return s.filter(self.test(*[F.col(f"s{i}") for i in range(n)]))


class ValueFilter(Leaper):
    """Keeps proposed values that pass ``test`` (source columns, then the value)."""

    def __init__(self, test):
        super().__init__(test=test)

    def apply(self, s: DataFrame, n: int) -> DataFrame:
        return s.filter(self.test(*[F.col(f"s{i}") for i in range(n)], F.col("val")))


class Passthrough(Leaper):
    def __init__(self):
        super().__init__()

    def apply(self, s: DataFrame, n: int) -> DataFrame:
        return s


class RelationLeaper:
    """``distinct``: no two rows of ``df`` are equal. Else it is made so where it proposes."""

    def __init__(self, df: DataFrame, distinct: bool = False):
        self.df, self.distinct = df, distinct

    def extend_with(self, keys):
        return ExtendWith(self.df if self.distinct else self.df.distinct(), keys, True)

    def extend_anti(self, keys):
        return ExtendAnti(self.df, keys)

    def filter_with(self, keys):
        return FilterWith(self.df, keys)

    def filter_anti(self, keys):
        return FilterAnti(self.df, keys)


def leapjoin(source: DataFrame, leapers: list, logic: Callable[..., tuple]) -> DataFrame:
    """``logic(source columns.., value)`` of the source's rows with every value that all leapers agree on.

    Tests of the source run first, then for each row the extension with fewest values proposes, the other extensions keep what they
    have too, and the rest keep or drop. With no extension the rows go on without a value; an anti-extension alone has nothing to drop from.
    """
    return _leapt(source, leapers, logic)[0].distinct()


def _leapt(source: DataFrame, leapers: list, logic: Callable[..., tuple]) -> tuple[DataFrame, bool]:
    """:func:`leapjoin` with equal rows left in, and whether there are none if ``source`` has none."""
    n = len(source.columns)
    s = source.toDF(*[f"s{i}" for i in range(n)])
    values = (ExtendWith, ExtendAnti, ValueFilter)
    custom = [x for x in leapers if not isinstance(x, Leaper)]
    for x in [x for x in leapers if isinstance(x, Leaper) and not isinstance(x, values)]:
        s = x.apply(s, n)
    extend = [x for x in leapers if isinstance(x, ExtendWith)]
    rest = [x for x in leapers if isinstance(x, values) and not isinstance(x, ExtendWith)]
    if rest and not extend:
        raise ValueError("nothing proposes values")
    is_set = all(x.one_row_a_value(s, n) for x in extend)
    if extend:
        s = extended(s, "val", *[[x.extender(n, f"{tag}{i}_") for i, x in enumerate(xs)] for tag, xs in (("x", extend), ("d", [x for x in rest if isinstance(x, ExtendAnti)]))])
    for x in [x for x in rest if isinstance(x, ValueFilter)]:
        s = x.apply(s, n)
    for f in custom:
        before, s = s, f(s)
        is_set = is_set and _only_filters(s, before)
    cols = [F.col(c) for c in s.columns]
    out = logic(*cols)
    return _rows(s, out), is_set and _keeps(out, cols)

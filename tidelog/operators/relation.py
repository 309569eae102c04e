"""Named sets of rows: facts that were inserted, and those that rules derived."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.plans.ir import Atom, RuleError
from tidelog.sources.tables import SENT_BYTES, materialise, table_path

#: Parts of a total before it is written anew as one.
MOST_PARTS = 8
#: From this many rows on a total isn't shuffled for new rows of at most ``SENT_BYTES`` that it has this many times over: they are broadcast to it.
LARGE_TOTAL, SENT_OF = 1_000_000, 64


@dataclass(frozen=True)
class Mark:
    """A state of a relation: facts were taken back ``epoch`` times, and since then came in ``number`` parts."""

    epoch: int
    number: int


@dataclass
class Part:
    """Facts that came in as the parts from ``first`` to ``last``."""

    df: DataFrame
    count: int
    first: int
    last: int


class Relation:
    """A set of rows of one schema. ``on_null``: what inserting a null does: "error", "drop" or "keep".

    A null that is kept equals itself in a set of facts, but unknown is unknown to rules: no atom joins on it, and no constant or test matches it.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str | T.StructType, on_null: str = "error"):
        self.spark, self.name, self.on_null = spark, name, on_null
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in self.schema.fields):
            raise RuleError(f"{name}: maps can't be compared")
        self.arity = len(self.schema.fields)
        self.pending: list[DataFrame] = []
        self.base: list[DataFrame] = []
        self.parts: list[Part] = []
        self.delta: DataFrame | None = None
        self.mark = Mark(0, 0)
        self.holds_derived = False

    def __call__(self, *args) -> Atom:
        return Atom(self, args)

    # facts in

    def insert(self, rows: DataFrame | Iterable) -> Relation:
        """Add facts; they count from the next commit or solve on."""
        names = [f.name for f in self.schema.fields]
        if not isinstance(rows, DataFrame):
            rows = [r if isinstance(r, (tuple, list, Row)) else (r,) for r in rows]
            rows = self.spark.createDataFrame(rows, self.schema)
        if len(rows.columns) != self.arity:
            raise RuleError(f"{self.name} has {self.arity} columns, not {len(rows.columns)}")
        rows = rows.toDF(*names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if self.on_null != "keep":
            bad = F.lit(False)
            for n in names:
                bad = bad | F.col(f"`{n}`").isNull()
            if self.on_null == "error":
                rows = rows.filter(~F.when(bad, F.raise_error(f"null in {self.name}")).otherwise(F.lit(False)))
            else:
                rows = rows.filter(~bad)
        self.pending.append(rows)
        return self

    def take_pending(self) -> DataFrame | None:
        out = union(self.pending)
        self.pending = []
        return out

    def commit(self) -> Relation:
        """Move inserted facts to the total, without an engine."""
        new = self.take_pending()
        if new is not None:
            if self.holds_derived:  # an inserted fact stays when the same one, derived before, goes
                new, _ = materialise(new.distinct())
                self.base.append(new)
                self.add(new)
            else:
                self.base.append(self.add(new))
        return self

    def add(self, rows: DataFrame, derived: bool = False, is_set: bool = False) -> DataFrame:
        """Write those of ``rows`` that are new, as the delta and a part of the total. ``is_set``: no two of them are equal."""
        self.holds_derived |= derived
        new = rows if is_set else rows.distinct()
        if self.count >= LARGE_TOTAL:
            new, n = materialise(new)
            if n * row_bytes(self.schema) <= SENT_BYTES and n * SENT_OF <= self.count:  # the total is read where it lies
                known = same_rows(self.df(), F.broadcast(new), "left_semi")
                new = same_rows(new, known, "left_anti")
            else:
                new = same_rows(new, self.df(), "left_anti")
        elif self.parts:
            new = same_rows(new, self.df(), "left_anti")
        part, n = materialise(new)
        self.delta = part if n else None
        if n:
            number = self.mark.number + 1
            self.mark = Mark(self.mark.epoch, number)
            self.parts.append(Part(part, n, number, number))
        if len(self.parts) > MOST_PARTS:
            self.parts = [Part(*materialise(self.df()), self.parts[0].first, self.parts[-1].last)]
        return part

    def reset(self) -> None:
        """Forget derived facts; inserted ones stay."""
        self.parts, self.delta, self.holds_derived = [], None, False
        self.mark = Mark(self.mark.epoch + 1, 0)
        facts = union(self.base)
        if facts is not None:
            self.add(facts)

    def since(self, mark: Mark) -> DataFrame | None:
        """Facts that came in after ``mark``, maybe with some from before where parts were written anew as one."""
        return union([p.df for p in self.parts if self.mark.epoch != mark.epoch or p.last > mark.number])

    def paths(self) -> list[str]:
        """The tables that the relation needs."""
        return [path for df in (*self.base, *(p.df for p in self.parts)) if (path := table_path(df))]

    # facts out

    @property
    def count(self) -> int:
        return sum(p.count for p in self.parts)

    def df(self) -> DataFrame:
        out = union([p.df for p in self.parts])
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def is_empty(self) -> bool:
        return not self.count

    def peek(self) -> DataFrame:
        """The facts in order; the relation keeps them."""
        return self.df().orderBy(*self.df().columns)

    def extract(self) -> DataFrame:
        """The facts in order; the relation is empty after. Inserted facts must be committed or solved before."""
        if self.pending:
            raise RuntimeError(f"{self.name} has facts that aren't solved")
        out = self.peek()
        self.base = []
        self.reset()
        return out

    def contains(self, *row) -> bool:
        test: Column = F.lit(True)
        for f, v in zip(self.schema.fields, row, strict=True):
            test = test & F.col(f"`{f.name}`").eqNullSafe(F.lit(v))
        return not self.df().filter(test).isEmpty()

    def __iter__(self) -> Iterator[Row]:
        return self.peek().toLocalIterator()


def union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.union(f)
    return out


def same_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left``'s rows that are (``left_semi``) or aren't (``left_anti``) in ``right``; nulls are equal."""
    fields, on = left.schema.fields, F.lit(True)
    l, r = left.toDF(*[f"l{i}" for i in range(len(fields))]), right.toDF(*[f"r{i}" for i in range(len(fields))])  # noqa: E741
    for i, f in enumerate(fields):
        on = on & (F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) if f.nullable else F.col(f"l{i}") == F.col(f"r{i}"))
    return l.join(r, on, how).toDF(*left.columns)


def without(new: DataFrame, total: DataFrame) -> DataFrame:
    """Rows of ``new`` that aren't in ``total``; nulls are equal."""
    return same_rows(new, total, "left_anti")


def row_bytes(schema: T.StructType) -> int:
    """What a row takes at most, as far as its types tell; text is taken for 256 bytes."""
    fixed = {T.ByteType: 8, T.ShortType: 8, T.IntegerType: 8, T.LongType: 8, T.FloatType: 8, T.DoubleType: 8, T.BooleanType: 8, T.DateType: 8, T.TimestampType: 8}
    return 16 + sum(fixed.get(type(f.dataType), 256) for f in schema.fields)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def from_rows(spark: SparkSession, name: str, schema: str, rows: Iterable, assume_distinct: bool = False) -> Relation:
    """A committed relation of literal rows."""
    r = Relation(spark, name, schema)
    if assume_distinct:
        part, n = materialise(spark.createDataFrame(list(rows), r.schema))
        if n:
            r.parts, r.base, r.mark = [Part(part, n, 1, 1)], [part], Mark(0, 1)
        return r
    return r.insert(rows).commit()


def from_map(name: str, df: DataFrame, schema: str, *exprs: Column) -> Relation:
    """A committed relation of ``exprs`` over the rows of ``df``."""
    return Relation(df.sparkSession, name, schema).insert(df.select(*exprs)).commit()


def merge(name: str, a: Relation, b: Relation) -> Relation:
    return Relation(a.spark, name, a.schema).insert(a.df()).insert(b.df()).commit()

"""Rows extended by one value on which several relations agree: for each row the relation with fewest values proposes."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A relation, the source's columns that are its keys, its own key columns, and its value column.
Extender = tuple[DataFrame, list, list[str], str]


def _on(keys: list, own: list[str]):
    return reduce(operator.and_, [(F.col(k) if isinstance(k, str) else k) == F.col(c) for k, c in zip(keys, own, strict=True)])

#: A key's values are proposed in this many lists, by a hash.
PIECES = 8
#: Values that are equal only if their hashes are.
_HASHED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType)


def _proposed(source: DataFrame, value: str, extender: Extender, checks: list[tuple[Extender, str]]) -> DataFrame:
    """``source`` with the extender's values, of which each check keeps (``left_semi``) or drops (``left_anti``) those it has too."""
    df, keys, own, v = extender
    if checks and keys and checks[0][0][1]:
        other, _, _, v_j = checks[0][0]
        kinds = [df.schema[v].dataType, other.schema[v_j].dataType]
        if kinds[0] == kinds[1] and isinstance(kinds[0], _HASHED):
            return _by_lists(source, value, extender, checks)
    rows = source.join(df, _on(keys, own)) if keys else source.crossJoin(df.select(F.col(v)))
    return _checked(rows.select(*source.columns, F.col(v).alias(value)), value, checks)


def _checked(rows: DataFrame, value: str, checks: list[tuple[Extender, str]]) -> DataFrame:
    for (other, keys, own, v), how in checks:
        rows = rows.join(other, _on([*keys, value], [*own, v]), how)
    return rows


def _by_lists(source: DataFrame, value: str, extender: Extender, checks: list[tuple[Extender, str]]) -> DataFrame:
    """:func:`_proposed`, where the values are dealt out to the first check in lists, and taken out of them where they are looked up
    in a hash table: a row for each would be many times their size, and would have to be sorted."""
    (df, keys, own, v), ((other, keys_j, own_j, v_j), how) = extender, checks[0]
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(PIECES))
    lists = df.groupBy(*own, piece(v).alias("in_piece")).agg(F.collect_list(v).alias("in_values"), F.count(F.lit(1)).alias("in_rows"))
    nulls = F.array_repeat(F.lit(None).cast(df.schema[v].dataType), (F.col("in_rows") - F.size("in_values")).cast("int"))
    at, to = [f"at_{i}" for i in range(len(keys_j))], [f"to_{i}" for i in range(len(keys_j))]
    near = source.join(lists, _on(keys, own)).select(
        *source.columns, *[(F.col(k) if isinstance(k, str) else k).alias(a) for k, a in zip(keys_j, at, strict=True)], "in_piece", F.concat("in_values", nulls).alias("in_values")
    )
    rows = near.repartition(*at, "in_piece").select(*source.columns, *at, "in_piece", F.explode("in_values").alias(value))
    known = other.select(*[F.col(c).alias(t) for c, t in zip(own_j, to, strict=True)], piece(v_j).alias("to_piece"), F.col(v_j).alias("to_value"))
    on = _on([*at, "in_piece", value], [*to, "to_piece", "to_value"])
    kept = rows.join(known.repartition(*to, "to_piece").hint("shuffle_hash"), on, how)
    return _checked(kept.select(*source.columns, value), value, checks[1:])


def extended(source: DataFrame, value: str, extenders: list[Extender], dropped: list[Extender] | None = None) -> DataFrame:
    """``source`` with every ``value`` that all ``extenders`` and none of ``dropped`` have for a row's keys (once for each of the proposer's rows).

    With several extenders the rows are first joined with each one's number of values by key, which also drops rows that one
    has none for; each extender then proposes for the rows where it has the fewest, and the others keep what they have too.
    """
    anti = [(x, "left_anti") for x in dropped or []]
    if not extenders[0][1] or len(extenders) == 1:  # no keys: any value
        return _proposed(source, value, extenders[0], anti)
    sized = source
    for i, (df, keys, own, _) in enumerate(extenders):
        counts = df.groupBy(*[F.col(c).alias(f"k{i}_{j}") for j, c in enumerate(own)]).agg(F.count(F.lit(1)).alias(f"n{i}"))
        sized = sized.join(counts, _on(keys, [f"k{i}_{j}" for j in range(len(own))])).drop(*[f"k{i}_{j}" for j in range(len(own))])
    fewest = F.least(*[F.col(f"n{i}") for i in range(len(extenders))])
    turn = F.coalesce(*[F.when(F.col(f"n{i}") == fewest, F.lit(i)) for i in range(len(extenders))])
    sized = sized.select(*source.columns, turn.alias("turn"))
    out = None
    for i, x in enumerate(extenders):
        rows = _proposed(sized.filter(F.col("turn") == i).select(*source.columns), value, x, [(y, "left_semi") for j, y in enumerate(extenders) if j != i] + anti)
        out = rows if out is None else out.union(rows)
    return out

"""Mixing sources to target weights on a time-varying curriculum.

Each source has a target number of words (weights, capped at ``max_repeat`` times its size, the excess
shared again) and a weight schedule over training time t in [0, 1]. Its cumulative demand is the integral of the
schedule; a document whose words lie at q of the source's stream is trained on at the t where
the demand reaches q. A range sort by t deals the sources' documents into one order; a document's place in it is its rank.

A source's stream is its documents in a fixed shuffled order (md5 of seed and doc_id), gone through again from
the start until the target is met; the stream ends inside a document, of which only the first words are taken. Thus every
source takes its rounded target exactly and no document more than ``ceil(target / size)`` times.

Schedules are linear: density ``1 + tilt * (2 t - 1)`` times the target, tilt in (-1, 1), dealt to the sources
in turn from ``tilts``; 0 is a constant share.

Null texts have size 0 and are taken 0 times, a null source is a source of its own (the last), null doc_ids sort as the
empty id, repeated rows are rows of their own, an empty table gives no rows, sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, Box, columns, prefix_sums, save

WEIGHTS = (5, 2, 1)
TILTS = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Targets from ``sizes`` (source, source_size), a row per source.

    Water filling: in ascending order of cap per weight, a source is capped while the level
    of those not yet capped lies above its cap; all others take weight times the final level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("__k", F.row_number().over(by_name) - 1)
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.col("__k") % len(xs) + 1).cast("int"))
    s = s.withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts)).withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("__cap") / F.col("weight"), "__k")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    w_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("__level", left / w_left).withColumn("__capped", F.col("__cap") < F.col("__level") * F.col("weight"))
    level = F.first(F.when(~F.col("__capped"), F.col("__level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("weight") * level)
    s = s.withColumn("target", F.least(F.coalesce(target, F.col("__cap")), F.col("__cap")))
    start = F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("source_start", start).select("source", "source_size", "weight", "tilt", "target", "source_start")


def time_of(q: Column, target: Column, tilt: Column) -> Column:
    """The t at which a source's cumulative demand target * ((1 - tilt) t + tilt t^2) reaches q."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(q, target), F.lit(0.0))))
    b = 1 - tilt
    return F.when(F.abs(tilt) < 1e-9, u).otherwise((-b + F.sqrt(b * b + 4 * tilt * u)) / (2 * tilt))


def plan_mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = 1.0, max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, and ``visits``.

    ``visits``: an array of (position, words) with one entry for each time that the mix takes the document.
    """
    rows = columns(docs, doc_id="long", text="string", source="string").withColumn("__rid", F.monotonically_increasing_id())
    return _planned(rows, weights, tilts, share, max_repeat, seed).drop("__rid")


def _planned(rows: DataFrame, weights, tilts, share: float, max_repeat: int, seed: int) -> DataFrame:
    """``plan_mix`` of the rows (doc_id, text, source, __rid), with __rid."""
    rows = rows.select(
        "doc_id", "source", "__rid",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("__key"),
    )
    rows = save(rows.withColumn("__last", F.col("source").isNull()), "mix-rows")
    sources = save(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, tilts, share, max_repeat).coalesce(1), "mix-sources")
    placed = prefix_sums(rows, ["__last", "source", "__key", "doc_id", "size", "__rid"], "size", "mix-sums")
    s = sources.select(F.col("source").isNull().alias("__n"), F.coalesce("source", F.lit("")).alias("__s"), *[c for c in sources.columns if c != "source"])
    d = placed.join(s, (placed["__last"] == s["__n"]) & (F.coalesce(placed["source"], F.lit("")) == s["__s"]))
    at = F.col("__start") - F.col("source_start")
    words = F.round("target").cast("long")
    most = F.lit(max_repeat + 1)
    visit = lambda e: F.struct(
        time_of(F.col("source_size") * e + at + F.col("size") / 2, F.col("target"), F.col("tilt")).alias("position"),
        F.greatest(F.lit(0), F.least(F.col("size"), words - (F.col("source_size") * e + at))).cast("long").alias("words"),
    )
    visits = F.filter(F.transform(F.sequence(F.lit(0), most - 1), visit), lambda v: v["words"] > 0)
    d = d.withColumn("visits", visits)
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda a, v: a + v["words"])
    return d.select("doc_id", "source", "__rid", "size", "source_size", "target", taken.alias("taken"), "visits")


def training_order(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = 1.0, max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position and first_rank for every row of ``docs``.

    ``first_rank``: the place (from 0) of the document's first visit among all visits of all documents, range-sorted by
    position, then doc_id; null, like ``first_position``, where the mix never takes it.
    """
    rows = columns(docs, doc_id="long", text="string", source="string").withColumn("__rid", F.monotonically_increasing_id())
    plan = save(_planned(rows, weights, tilts, share, max_repeat, seed), "mix-plan")
    visits = plan.select("__rid", "doc_id", "size", F.posexplode("visits").alias("turn", "v")).select("__rid", "doc_id", "size", "turn", "v.position")
    ranked = prefix_sums(visits, ["position", "doc_id", "size", "turn", "__rid"], "size", "mix-order")
    first = ranked.filter("turn = 0").select("__rid", F.col("position").alias("first_position"), F.col("__rank").alias("first_rank"))
    return plan.select("__rid", "doc_id", "size", "source_size", "target", "taken").join(first, "__rid", "left").drop("__rid")


def mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, share: float = 1.0, max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in training order (sorted by position, range by range).

    A visit that takes only the first words of a document has them joined by single spaces; ``n_chars``, where
    there is such a column, is set to their length.
    """
    box = Box(docs)
    kept = save(box.rows.select(box.struct().alias("__row"), F.monotonically_increasing_id().alias("__rid")), "mix-input")
    given = {"doc_id": "long", "text": "string", "source": "string"}
    flat = kept.select("__rid", *[box.inside("__row", c).cast(t).alias(c) for c, t in given.items()])
    visits = _planned(flat, weights, tilts, share, max_repeat, seed).select("__rid", "size", F.explode("visits").alias("__v"))
    out = kept.join(visits.select("__rid", "size", "__v.position", "__v.words"), "__rid")
    whole = box.inside("__row", "text").cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(whole)
    ordered = out.withColumn("__text", text).repartitionByRange("position", "__rid").sortWithinPartitions("position", "__rid")
    part = F.col("words") < F.col("size")
    own = {"text": lambda c: F.col("__text"), "n_chars": lambda c: F.when(part, F.length("__text")).otherwise(c)}
    return ordered.select(*[own.get(f.name, lambda c: c)(c).cast(f.dataType).alias(f.name) for f, c in zip(docs.schema.fields, box.out("__row"), strict=True)])

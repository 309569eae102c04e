"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in the order (doc_id, text checksum); per-partition totals give every row the
number of bytes before it, and a row goes to the shard in whose equal span of bytes its middle lies. Shards are
therefore contiguous in doc_id and differ from the target by less than one row at either end.

Null doc_ids come first, a null text has no bytes (a row still counts ``overhead``), repeated rows are
placed one after the other, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Box, columns, prefix_sums, save


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and byte_start for every row of ``docs``."""
    return _placed(columns(docs, doc_id="long", text="string").withColumn("__tie", F.monotonically_increasing_id()), shards, overhead).drop("__tie")


def _placed(rows: DataFrame, shards: int, overhead: int) -> DataFrame:
    """``shard_by_bytes`` of the rows (doc_id, text, __tie), with __tie, which is unique and spreads repeated rows over the ranges."""
    t = F.coalesce("text", F.lit(""))
    rows = rows.select("doc_id", (F.octet_length(t) + F.lit(overhead)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), "__tie")
    placed = prefix_sums(save(rows, "shard-rows"), ["doc_id", "text_crc32", "__tie"], "size", "shard-sums")
    total = int(placed.agg(F.sum("size")).first()[0] or 1)
    middle = F.col("__start").cast("decimal(38,0)") * 2 + F.col("size")
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(2 * total).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__rank") - F.col("__first")).alias("slot"), F.col("__start").alias("byte_start"), "__tie"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, overhead: int = 8) -> str:
    """Write every row of ``docs`` below ``path``, one folder for each shard, files sorted by slot.

    Returns the name of the column of the shard, ``shard`` or, where ``docs`` has one, that with underscores after it.
    """
    box, name = Box(docs), "shard"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    kept = save(box.rows.select(box.struct().alias("row"), F.monotonically_increasing_id().alias("__tie")), "shard-input")
    flat = kept.select(box.inside("row", "doc_id").cast("long").alias("doc_id"), box.inside("row", "text").cast("string").alias("text"), "__tie")
    placed = _placed(flat, shards, overhead).select("__tie", "shard", "slot")
    rows = kept.join(placed, "__tie").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*box.out("row"), F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name

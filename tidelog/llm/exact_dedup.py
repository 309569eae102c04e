"""Exact de-duplication through a log-structured merge index of text digests.

Memtables: rows come in batches, each a memtable that keeps the smallest key and the number of rows for each digest. It is flushed as a
run, sorted by digest, with a bitmap filter of its digests. Compaction merges the runs of a level into one of the next once
``fanout`` are there: entries that no other run's filter may hold go over as they are, only the others are shuffled, and of each digest the
smallest key and all rows are kept. A digest with more than one row is a hit; hits are
compared byte by byte with the row that stays, and digests that two different texts share are told
apart by the texts themselves. Only DataFrame functions are used.

Copies of one text are dealt over as many tasks as ``PER_TASK`` rows of a group take, each with the text that stays, so a text that
a third of all rows share is no task's alone.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space. A null text is the
empty text. Null doc_ids come after all others; of rows with equal doc_id and text one stays. Very long texts
are digested whole; an empty table gives no rows; other columns are carried in a struct and can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import WS, Box, KeyFilter, columns, key_filter, maybe_in, new_path, save, save_counted, settle

#: Rows of one group that one task compares.
PER_TASK = 20_000
#: Groups of more rows than that whose digests are broadcast, of about 100 bytes each.
MOST_HOT = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass
class Run:
    """digest, first (the smallest key) and n (rows), sorted by digest, and the filter of its digests."""

    entries: DataFrame
    holds: KeyFilter
    level: int


def _merged(parts: list[DataFrame]) -> DataFrame:
    both = functools.reduce(DataFrame.unionByName, parts)
    return both.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


class LsmDigestIndex:
    """Runs of digests in the shared folder, merged level by level; ``add`` flushes a memtable, ``compact`` merges all runs to one."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.runs: list[Run] = []

    def add(self, keyed: DataFrame) -> Run:
        """Flush the memtable of a batch of rows (digest, key)."""
        table = keyed.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        run = self._flush(table, 0)
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= self.fanout:
            self._merge(full, level + 1)
            level += 1
        return run

    def _flush(self, entries: DataFrame, level: int) -> Run:
        entries, count = save_counted(entries.sortWithinPartitions("digest"), f"lsm-run{level}")
        self.runs.append(Run(entries, key_filter(entries, "digest", "lsm-filter", count), level))
        return self.runs[-1]

    def _merge(self, runs: list[Run], level: int) -> None:
        alone, shared = [], []
        for r in runs:
            entries = r.entries.withColumn("both", F.lit(False))
            for other in (x for x in runs if x is not r):
                entries = maybe_in(entries, "digest", other.holds).withColumn("both", F.col("both") | F.col("__maybe")).drop("__maybe")
            alone.append(entries.filter("not both").drop("both"))
            shared.append(entries.filter("both").drop("both"))
        whole = functools.reduce(DataFrame.unionByName, [*alone, _merged(shared)])
        self.runs = [r for r in self.runs if r not in runs]
        self._flush(whole, level)

    def compact(self) -> DataFrame:
        """The entries of all runs, merged to one."""
        if len(self.runs) > 1:
            self._merge(list(self.runs), max(r.level for r in self.runs) + 1)
        return self.runs[0].entries


def digested(docs: DataFrame, digest: Callable[[Column], Column], batches: int, box: Box) -> DataFrame:
    """digest, key (no_id, doc_id, rid: in this order rows stay), row and batch for every row of ``docs``, saved batch by batch."""
    rows = box.rows.select(
        digest(normalised(box["text"].cast("string"))).alias("digest"),
        F.struct(box["doc_id"].isNull().alias("no_id"), box["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid")).alias("key"),
        box.struct().alias("row"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"),
    )
    path = new_path(docs.sparkSession, "lsm-rows")
    rows.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def hits(rows: DataFrame, box: Box, many: DataFrame) -> DataFrame:
    """digest, key, keep and n of the rows whose digest is in ``many`` (digest, first, n), verified by their bytes."""
    filt = key_filter(many, "digest", "lsm-filter")
    texts = rows.select("digest", "key", box.inside("row", "text").cast("string").alias("text"))
    salts = F.ceil(F.col("n") / PER_TASK).cast("int")
    hot, count = save_counted(many.filter(F.col("n") > PER_TASK).select("digest", salts.alias("salts")), "lsm-hot")
    hot = F.broadcast(hot) if count <= MOST_HOT else hot
    found = maybe_in(texts, "digest", filt).filter("__maybe").select("digest", "key", normalised(F.col("text")).alias("text"))
    found = found.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("key.rid"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    found = save(found, "lsm-hits")
    dealt = many.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    known = save(found.join(dealt, ["digest", "salt"]).select("digest", "salt", "key", "first", "n", "text"), "lsm-known")
    stays = known.filter("key = first").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    seen = known.join(stays, ["digest", "salt"]).select("digest", "key", F.col("first").alias("keep"), "n", (F.col("text") == F.col("kept_text")).alias("same"))
    seen = save(seen, "lsm-seen")
    clash = seen.filter("not same").select("digest").distinct()
    if not clash.isEmpty():  # two texts with one digest: the texts decide
        exact = known.join(clash, "digest", "left_semi")
        groups = exact.groupBy("digest", "text").agg(F.min("key").alias("keep"), F.count(F.lit(1)).alias("n"))
        exact = exact.drop("n").join(groups, ["digest", "text"]).select("digest", "key", "keep", "n")
        seen = seen.join(clash, "digest", "left_anti").select("digest", "key", "keep", "n").unionByName(exact)
    return seen.select("digest", "key", "keep", "n")


def indexed(rows: DataFrame, batches: int, fanout: int) -> DataFrame:
    """The merged entries of ``rows``, added batch by batch."""
    index = LsmDigestIndex(rows.sparkSession, fanout)
    for k in range(batches):
        index.add(rows.filter(F.col("batch") == k).select("digest", "key"))
    return index.compact()


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, batches: int = 4, fanout: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (the digest) for every row of ``docs``."""
    docs = columns(docs, doc_id="long", text="string")
    box = Box(docs)
    rows = digested(docs, digest, batches, box)
    many = save(indexed(rows, batches, fanout).filter("n > 1"), "lsm-many")
    alone = maybe_in(rows.select("digest", "key"), "digest", key_filter(many, "digest", "lsm-filter"))
    lone = alone.filter("__maybe").select("digest", "key").join(many, "digest", "left_anti")  # false alarms of the filter
    one = alone.filter("not __maybe").select("digest", "key").unionByName(lone).select("digest", "key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("n"))
    every = one.unionByName(hits(rows, box, many))
    return every.select(F.col("key.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("key") == F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    box = Box(docs)
    rows = digested(docs, sha256, batches, box)

    def lost() -> DataFrame:
        many = save(indexed(rows, batches, fanout).filter("n > 1"), "lsm-many")
        return hits(rows, box, many).filter("key != keep").select("key.rid")

    gone = settle(docs.sparkSession, "lsm-gone", lost)  # the index is done with; its rows stay
    tested = maybe_in(rows.select("row", "key.rid"), "rid", key_filter(gone, "rid", "lsm-filter"))
    kept = tested.filter("not __maybe").select("row").unionByName(tested.filter("__maybe").join(gone, "rid", "left_anti").select("row"))
    return kept.select(*box.out("row"))

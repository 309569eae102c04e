"""Helpers shared by the operators of this subpackage.

Intermediate results that are read more than once, and every cut of lineage, go
through :func:`save`: a Parquet table below ``spark.checkpoint.dir``, which all
executors share, so that a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a regular-expression class body.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
PREFIX_COLUMNS = "__part int, __cum long, __idx long"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session that runs in one process may go without: it gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext.getCheckpointDir()):
        found = own
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: For each :func:`settle` under way, the tables saved since it began.
_passing: list[list[str]] = []


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back (lineage ends there)."""
    path = new_path(df.sparkSession, tag)
    if _passing:
        _passing[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """:func:`save`, and the number of rows; one job."""
    seen = Observation()
    out = save(df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    return out, int(seen.get["n"])


def settle(spark: SparkSession, tag: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` returns, saved; the tables saved while building it are deleted, as only it reads them."""
    _passing.append([])
    try:
        built = build()
    finally:
        used = _passing.pop()
    out = save(built, tag)
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, used):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


#: Rows with whole texts in one Arrow batch.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` rows from now on: with whole texts in them they bound what a task holds outside
    the heap. The setting stays, because a frame is planned only after its operator has returned it; a smaller one is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound name."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(df: DataFrame, order: list[str], size: str, tag: str) -> DataFrame:
    """Add ``__start`` (sum of ``size`` of all rows before) and ``__rank`` (their count) in the global order.

    Rows are range-partitioned and sorted, each partition adds up its own rows in a stream, and the
    partitions' totals (one row per partition) give the offsets: no task sees more than its partition.
    """

    def running(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, cum, idx = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if rows := batch.num_rows:
                own = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                added = [np.full(rows, part, np.int32), total - own + cum, np.arange(idx, idx + rows)]
                cum, idx = cum + int(total[-1]), idx + rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[*batch.schema.names, "__part", "__cum", "__idx"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + PREFIX_COLUMNS
    dealt = save(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema), tag)
    totals = dealt.groupBy("__part").agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    rows, s, n = [], 0, 0
    for t in totals:
        rows.append((t["__part"], s, n))
        s, n = s + t["s"], n + t["n"]
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __s long, __n long")
    return (
        dealt.join(F.broadcast(offsets), "__part")  # a row per partition
        .withColumn("__start", F.col("__s") + F.col("__cum"))
        .withColumn("__rank", F.col("__n") + F.col("__idx"))
        .drop("__part", "__cum", "__idx", "__s", "__n")
    )


#: Bits of a key filter for each key, and the most bits of a filter: 2**28 are 32 MB to broadcast.
BITS_PER_KEY, MOST_BITS = 8, 1 << 28


@dataclass
class KeyFilter:
    """A one-hash filter: rows (bucket, bitmap) of ``bits`` bits in all; None where the keys are too many to broadcast one."""

    rows: DataFrame | None
    bits: int


def key_filter(keys: DataFrame, key: str, tag: str = "key-filter", count: int | None = None) -> KeyFilter:
    """A saved filter of ``keys`` (a saved table), sized by their ``count``."""
    count = keys.count() if count is None else count
    bits = 1 << max(20, (count * BITS_PER_KEY - 1).bit_length())
    if bits > MOST_BITS:
        return KeyFilter(None, bits)
    h = F.expr(f"pmod(xxhash64(`{key}`), {bits}L)")
    rows = keys.select(F.bitmap_bucket_number(h).alias("__b"), F.bitmap_bit_position(h).alias("__p")).groupBy("__b").agg(F.bitmap_construct_agg("__p").alias("__bm"))
    return KeyFilter(save(rows, tag), bits)


def maybe_in(df: DataFrame, key: str, filt: KeyFilter) -> DataFrame:
    """Add ``__maybe``: false only where ``key`` is surely not among the filter's keys."""
    if filt.rows is None:
        return df.withColumn("__maybe", F.lit(True))
    h = F.expr(f"pmod(xxhash64(`{key}`), {filt.bits}L)")
    p = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col("__bm"), (p / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (p % 8 + 1).cast("int"))) != 0
    out = df.withColumn("__b", F.bitmap_bucket_number(h)).join(F.broadcast(filt.rows), "__b", "left")  # bits / 8 bytes, at most 32 MB
    return out.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__b", "__bm")


class Box:
    """The rows of ``df`` under names of their own (``c0``, ``c1``, ..), so that none of its columns can clash with another."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name)}")

    def struct(self) -> Column:
        return F.struct(*[F.col(f"c{i}") for i in range(len(self.names))])

    def inside(self, row: str, name: str) -> Column:
        return F.col(f"{row}.c{self.names.index(name)}")

    def out(self, row: str) -> list[Column]:
        """The columns of ``row``, a struct of this box, under their first names."""
        return [F.col(f"{row}.c{i}").alias(n) for i, n in enumerate(self.names)]


def columns(df: DataFrame, **want: str) -> DataFrame:
    """The named columns only, by exact name (case counts) and with their types, so that extra columns can't clash."""
    box = Box(df)
    return box.rows.select(*[box[k].cast(t).alias(k) for k, t in want.items()])


def without_null(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` with nulls of ``name`` as 0 and a column ``__null``: Python sees a long column with nulls as floats."""
    return df.withColumn("__null", F.col(name).isNull()).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def with_null(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Undo :func:`without_null`."""
    return df.withColumn(name, F.when(~F.col("__null"), F.col(name))).drop("__null")

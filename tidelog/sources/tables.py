"""Reading facts, and writing intermediate results where all executors reach them."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session that runs in one process may go without: it gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: For each :func:`scratch` under way, the tables written since it began.
class _Stack(threading.local):
    def __init__(self):
        self.lists: list[list[tuple[SparkSession, str]]] = []


_written = _Stack()


#: Bytes of files for each task of a shuffle, and of shuffled data for tasks that are joined into one.
TASK_FILES, TASK_SHUFFLED = 4 << 20, 16 << 20


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bytes(spark: SparkSession, size: str) -> int:
    return -1 if size.startswith("-") else int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


def _dealt(df: DataFrame) -> contextlib.AbstractContextManager[None]:
    """Meanwhile shuffles have a number of tasks that grows with the files read, so that a task's sorts and hash tables don't, and rows
    that are dealt out by some of a join's keys aren't dealt out again by all of them."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    count, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    return _set(spark, {
        count: str(max(int(spark.conf.get(count)), min(read // TASK_FILES, 4000))), joined: str(min(_bytes(spark, spark.conf.get(joined)), TASK_SHUFFLED)),
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    })


def materialise(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read back, and its row count; one job. The lineage ends here."""
    seen = Observation()
    path = f"{shared_dir(df.sparkSession)}/facts-{uuid.uuid4().hex}"
    if _written.lists:
        _written.lists[-1].append((df.sparkSession, path))
    with _dealt(df):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._facts_path = path
    return out, int(seen.get["n"])


#: Of files or of rows that were measured, up to which a join's side is broadcast; and of new rows that are sent to a large total.
SENT_FILE, SENT_BYTES = 64 << 10, 4 << 20


@contextlib.contextmanager
def few_sent(spark: SparkSession) -> Iterator[None]:
    """Meanwhile only small sides of joins are sent through the driver. Spark goes by the size of files, of which facts may take fifty
    times as much in memory, and a fixpoint would send them anew each round; what isn't sure to be small is measured in a shuffle first,
    and stays there unless it is tiny."""
    auto, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(measured, None)
    own = _bytes(spark, spark.conf.get(auto))
    with _set(spark, {auto: str(min(own, SENT_FILE)), measured: str(min(_bytes(spark, before) if before else own, SENT_FILE))}):
        yield


def leaves_stay(df: DataFrame) -> bool:
    """Whether all that ``df`` reads is too large to be planned as a broadcast, and reading it again gives the same rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves, sent = plan.collectLeaves(), _bytes(df.sparkSession, df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return bool(plan.deterministic()) and all(int(leaves.apply(i).stats().sizeInBytes()) > sent for i in range(leaves.size()))


def table_path(df: DataFrame) -> str | None:
    """Where ``df`` was written, if :func:`materialise` returned it."""
    return getattr(df, "_facts_path", None)


@contextlib.contextmanager
def scratch(needed: Callable[[], list[str]]) -> Iterator[None]:
    """Delete the tables written meanwhile at the end, but for those that are ``needed`` then. Older tables are left alone."""
    _written.lists.append([])
    try:
        yield
    finally:
        kept, made = set(needed()), _written.lists.pop()
        for spark, path in made:
            if path not in kept:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_facts(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Facts from delimited text (``sep``: comma, tab or space)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, sep=sep)


def write_facts(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.format(format).save(path)


def intern_strings(df: DataFrame, column: str) -> DataFrame:
    """(id, column): a dense number for each distinct string, in their order."""
    names = df.select(column).distinct()
    parts = names.repartitionByRange(column).sortWithinPartitions(column).withColumn("__m", F.monotonically_increasing_id())
    parts, _ = materialise(parts)
    part = F.shiftright("__m", 33)
    totals = parts.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect()  # a row per partition
    offsets, at = [], 0
    for t in totals:
        offsets.append((t["__p"], at))
        at += t["n"]
    off = df.sparkSession.createDataFrame(offsets, "__p long, __o long")
    return parts.withColumn("__p", part).join(F.broadcast(off), "__p").select((F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__o")).alias("id"), column)

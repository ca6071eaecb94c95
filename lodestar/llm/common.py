"""Shared pieces of the training-data operators: tables on the shared folder, Arrow slicing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: \x20 and \x09-\x0D.
SPACE = r"\x20\x09-\x0D"


#: Rows of an Arrow batch: texts are long, so few are enough.
BATCH = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder does in local mode (one machine); on a cluster that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


#: Folders of written tables, so that those no longer needed can go.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table on the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    Where the most ``rows`` it can have are known, it is written in no more files than their bytes
    and the cores of the cluster ask for.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows * row_bytes(df) >> 24))
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more. What a lazy result reads stays."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


#: Bytes of a table that may be broadcast.
SMALL = 8 << 20


def row_bytes(table: DataFrame) -> int:
    """About how many bytes a row takes in a broadcast: 16 for itself, 8 a number, 48 a string; other types count 256."""
    each = {"bigint": 8, "int": 8, "double": 8, "boolean": 8, "date": 8, "string": 48}
    return 16 + sum(each.get(kind, 256) for _, kind in table.dtypes)


def fits(table: DataFrame, limit: int = SMALL) -> bool:
    """Whether ``table`` (already written) takes at most ``limit`` bytes."""
    return table.count() * row_bytes(table) <= limit


def small(table: DataFrame, limit: int = SMALL) -> DataFrame:
    """Hint a broadcast only where ``table`` (already written) takes at most ``limit`` bytes; beyond that it joins by shuffle."""
    return F.broadcast(table) if fits(table, limit) else table


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def most_frequent(counts: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The rows of written ``counts`` with the largest ``by``, about ``limit`` of them at most.

    A histogram over sixteenths of powers of two (a few hundred rows) gives the threshold, so no
    task sorts and none sends its own top list to the driver. Of the boundary level a hashed share
    is taken.
    """
    level = F.floor(F.log2(F.greatest(F.col(by), F.lit(1)).cast("double")) * 16)
    left, at, share = limit, -1, 0.0
    for r in sorted(counts.groupBy(level.alias("l")).count().collect(), reverse=True):
        if r[1] > left:
            at, share = r[0], left / r[1]
            break
        left -= r[1]
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))
    return counts.where((level > at) | ((level == at) & hashed))


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``chars`` bytes of text (one row at least)."""
    for batch in batches:
        size = batch.column(text).nbytes if batch.num_rows else 0
        step = max(1, batch.num_rows * chars // max(size, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    release()


def release() -> None:
    """Give freed memory back to the system, as Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_MEMORY: dict[str, dict] = {}


def memory(name: str) -> dict:
    """A dictionary that a Python worker keeps between tasks of one operator; that of the operator before it is dropped."""
    if name not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[name] = {}
    return _MEMORY[name]


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node``, ``component`` (smallest node
    reachable), one row per node that has an edge to another node. Each round is a join and a
    partial aggregation, written to the shared folder (the round before is deleted then); nothing
    is collected but a count and a checksum that tell whether a round changed anything.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    before = state(current)
    while before[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, current = current, materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges", before[0])
        forget(last)
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

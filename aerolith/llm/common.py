"""What the operators of this subpackage share: shared storage, folds and batches of bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
BLOCK_BYTES = 1 << 19


#: Rows of an Arrow batch for these operators; texts are long, and a batch is held whole on both sides of the pipe.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. The session's Arrow batches are made smaller, unless its user has set their size at all."""
    if not spark.conf._jconf.contains(_ROWS):
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set it is a folder of the default file system; if that is this machine's, a temporary one if
    everything runs in one process, and else the warehouse, which a cluster must share for tables anyhow. That it is shared
    is tried out once a session; if it is not, rows would be lost, so it is refused and spark.checkpoint.dir must be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _OWN.get(spark.sparkContext.applicationId)
    if not at:
        default = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        if default.getScheme() != "file":
            at = f"{default.getHomeDirectory()}/aerolith-{uuid.uuid4().hex}"
        elif spark.sparkContext.master.split("[")[0] == "local":
            at = f"file://{tempfile.mkdtemp(prefix='aerolith-')}"
        else:
            at = spark.conf.get("spark.sql.warehouse.dir")
            if not _is_shared(spark, at):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def _is_shared(spark: SparkSession, at: str) -> bool:
    """Whether the driver sees what tasks on all cores of the cluster write to the folder."""
    path, tasks = f"{at.rstrip('/')}/aerolith-{uuid.uuid4().hex}", 2 * max(2, spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = held.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(held)
        return sum(x.getPath().getName().startswith("part-") for x in files) == tasks
    finally:
        _drop(spark, path)


_OWN: dict[str, str] = {}


def written(df: DataFrame, narrow: bool = False) -> DataFrame:
    """df as a table in the shared folder, read again: lineage is cut and nothing is computed twice.

    narrow: rows of a few numbers, which are written as one file for each core of the cluster at most.
    """
    spark = df.sparkSession
    df = df.coalesce(max(2, spark.sparkContext.defaultParallelism)) if narrow else df
    path = f"{shared_dir(spark)}/aerolith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() returned and that nothing reads any more."""
    for df in tables:
        _drop(df.sparkSession, df._written_at)


def broadcast(spark: SparkSession, value):
    """A broadcast that release() destroys."""
    out = spark.sparkContext.broadcast(value)
    _LIVE.append(out)
    return out


_LIVE: list = []


def release(since: int = 0) -> None:
    """Destroy the broadcasts made since len(live()) was that number: for when what reads them is written."""
    while len(_LIVE) > since:
        _LIVE.pop().destroy()


def live() -> int:
    return len(_LIVE)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        return


def fold(id_col: str, parts: int = 5) -> Column:
    """crc32 of the id's decimal text modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def is_fold(id_col: str, which: int) -> Column:
    """True where the fold is which; false for a null id."""
    return F.coalesce(fold(id_col) == which, F.lit(False))


def as_bytes(text_col: str) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def blocks(column: pa.Array, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to budget at most; a larger row stands alone."""
    ends = offsets(column)[1:]
    lo, n = 0, len(column)
    base = int(offsets(column)[0]) if n else 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield lo, hi
        base, lo = int(ends[hi - 1]), hi


def offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, width)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and the start of each row with one end more; nothing is copied."""
    at = offsets(column).astype(np.int64)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the number of each row, from 0, in an order without ties.

    Rows are range-sorted and each range counts its own; only the counts of whole ranges, one a partition, are added up in
    one place.
    """
    part, n = unused(df, "part"), unused(df, "n")
    dealt = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(before, F.lit(0)).alias(n))
    number = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1 + F.col(n)
    return dealt.join(F.broadcast(counts), part).withColumn(name, number).drop(part, n)

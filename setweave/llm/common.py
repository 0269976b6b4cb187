"""Scratch tables, batches of texts and distributed ranks shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, without this call
    _LIBC = None
#: ASCII white space parts words; everything else, in any script, belongs to one.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine, a
    temporary folder is made and set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="setweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/setweave/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        paths = [t] if isinstance(t, str) else {p.rsplit("/", 1)[0] for p in t.inputFiles()}
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether ``df``, a materialised table, has at most ``limit`` rows: the check before any broadcast."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``limit`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if is_small(df, limit) else df


def ascii_lower(text: Column) -> Column:
    """Null as empty; only A-Z lowered."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place, from 0, in the order given, without bringing all rows to one task.

    Rows are range partitioned and sorted; only one count per partition reaches the driver.
    """
    raw = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = save(raw, "ordinal")
    part = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    if not before:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("__at")
    starts = df.sparkSession.createDataFrame(before, "__p long, __start long")
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__start") + row).drop("__at", "__p", "__start")


def release() -> None:
    """Give freed memory back to the machine: idle Python workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``limit`` bytes of text; a longer text stands alone.

    Memory freed meanwhile is given back after each piece.
    """
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        at = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        begin = 0
        while begin < n:
            base = at[begin - 1] if begin else 0
            end = max(begin + 1, int(at.searchsorted(base + limit, side="right")))
            yield b.slice(begin, end - begin)
            release()
            begin = end


def texts(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts, without an offset, for work on its buffers."""
    return pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")])

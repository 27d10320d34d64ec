"""Helpers of the training-data operators: shared folder, stable tables, parameters."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a single-process session without that setting gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; what is written there goes when Python exits."""
    path = f"{shared_base(spark)}/folioscope-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system; a session that has ended already is no error."""
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    try:
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage: a lost executor costs a read, not the work above, and
    whatever the writing task decided (partition ids, samples) stays as it was.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    remove(df.sparkSession, df.stored_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, values: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``values`` (unique keys), in which no key fills a task.

    ``weight`` is a column of ``values`` with the number of rows that its key has.
    Keys with over a thousandth of all rows are fewer than a thousand; they are
    broadcast, and all others are joined by key.
    """
    total = values.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1000, total // 1000)
    few = F.broadcast(values.where(hot))
    cold = rows.join(few.select(key), key, "left_anti").join(values.where(~hot), key, how)
    return rows.join(few, key).unionByName(cold).drop(weight)


#: Rows of the table that ``without_keys`` broadcasts, of 64 bits each (1 MiB of bits in all).
FILTER_ROWS = 1 << 17


def without_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that surely have none of the keys, rows that may have one), without moving a row.

    A table of bits of fixed size, one for each hash of a key, is broadcast; it
    grows with nothing. What it can't tell apart has to be joined by key.
    """
    h = F.xxhash64(*on)
    slot, bit = F.pmod(h, F.lit(FILTER_ROWS)), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")
    mask = F.bit_or(F.expr("shiftleft(1L, _bit)"))
    held = stored(keys.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(mask.alias("_mask")), "key-bits")
    marked = rows.withColumn("_slot", slot).withColumn("_bit", bit).join(F.broadcast(held), "_slot", "left")
    maybe = F.coalesce(F.getbit("_mask", F.col("_bit")) == 1, F.lit(False))
    return marked.where(~maybe).select(*rows.columns), marked.where(maybe).select(*rows.columns)


def give_back() -> None:
    """Hands what a task has freed back to the system: workers live longer than their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of an Arrow batch of whole texts; the JVM and the worker hold a batch each for every task.
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Actions inside hand at most ``rows`` rows at once to Python; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ordered_offsets(parts: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over the rows of a table with one row per
    partition or file. Such a table has as many rows as there are files."""
    from pyspark.sql import Window

    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))

"""What the operators share: the folder that all executors see, staged tables and Arrow batch sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to a Python worker at a time; whole texts may be long.
BATCH_ROWS = 250
#: Ids (8 bytes each, 32 in a hash table) that are sent to all tasks rather than have texts shuffled.
BROADCAST_IDS = 2_000_000
#: The most keys that count as hot, and the fewest rows that make a key hot.
HOT_KEYS, HOT_ROWS = 100_000, 256


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, the warehouse, which executors see as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop_shared, spark, path)
    return path


def _drop_shared(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before
        return


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    trim_jvm(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ids(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is among ids (left_semi) or not (left_anti); ids has one column id, distinct.

    Up to BROADCAST_IDS of them go to all tasks, so that wide rows stay where they are; beyond it, rows are shuffled.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    name = spare(rows.columns, "_id_")
    ids = ids.select(F.col("id").alias(name))
    return rows.join(F.broadcast(ids) if few else ids, rows[key] == ids[name], how)


def hottest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """hot, parts: the keys with by far the most of the n rows, and how many tasks to deal each to.

    A key is hot with over n / HOT_KEYS rows, so there are HOT_KEYS of them at most, which may be broadcast.
    """
    least = max(HOT_ROWS, n // HOT_KEYS)
    return rows.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("c")).filter(F.col("c") > least).select("hot", F.ceil(F.col("c") / least).cast("int").alias("parts"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Bytes at which a batch has enough, whatever its rows.
ENOUGH_BYTES = 16 << 20


def merged(batches, rows: int):
    """Arrow batches put together to `rows` rows or ENOUGH_BYTES, or more; the last may have fewer."""
    import pyarrow as pa

    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= ENOUGH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def settle(spark: SparkSession) -> None:
    """Give back what the driver holds but doesn't use, in Python and in the JVM, which grows its heap while there is room before it collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    trim()


def trim_jvm(spark: SparkSession) -> str | None:
    """Give back what the C allocator of the driver's JVM holds but doesn't use: compilers and codecs of many threads leave several hundred MB.

    Returns the JVM's answer; None from a JVM without the command (System.trim_native_heap), where nothing happens.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    array = lambda kind, *items: _array(gateway, kind, items)
    try:
        kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        # by the interface: the server's own class isn't open to reflection
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JError:  # another JVM
        return None


def _array(gateway, kind, items):
    out = gateway.new_array(kind, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out


def trim() -> None:
    """Give back what a worker's allocators hold but don't use; called at the end of a task, as workers live on."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spare(columns, name: str) -> str:
    """name, or with underscores added until no column begins with it."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name

"""Row order: the dense number ``__row`` that positional operators read.

One Parquet file's own row index is used as it is. Several files are numbered by one count for each file: a table of as
many rows as files, never the rows themselves. Other frames are range-partitioned on the order's keys and numbered by one
count for each partition.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "__row"


def offsets(counts: DataFrame, key: str, spark: SparkSession) -> DataFrame:
    """``key, start`` of ``key, n``: rows before each. As many rows as files or partitions, so the driver adds them up."""
    start, out = 0, []
    for k, n in sorted(map(tuple, counts.select(key, "n").collect())):
        out.append((k, start))
        start += n
    return spark.createDataFrame(out, counts.select(key, F.col("n").alias("start")).schema)


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet path with ``__row``: files in the order of their names, rows in the file's order."""
    read = spark.read.parquet(path)
    names = read.columns
    raw = read.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    counts = raw.groupBy("__file").agg(F.count("*").alias("n"))
    if len(read.inputFiles()) <= 1:
        return raw.select(*names, F.col("__at").alias(ROW))
    start = F.broadcast(offsets(counts, "__file", spark))  # a row for each file
    return raw.join(start, "__file").select(*names, (F.col("start") + F.col("__at")).alias(ROW))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``, deleted when the driver ends. Where the folder is unset on
    one machine (tests) it is one of our own; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"

    def tidy() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the store's owner clears its checkpoint folder
            return

    atexit.register(tidy)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so lineage is cut, the plan runs once and any executor
    may be lost."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sorted range partitions, cut off from their lineage, with ``__pid`` and the place in the partition ``__pos``."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    low = F.lit((1 << 33) - 1)
    return checkpointed(dealt.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().bitwiseAND(low).alias("__pos")))


def number_rows(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` with ``__row`` by the keys; they should make the order total."""
    kept = ranged(df, *keys)
    start = F.broadcast(offsets(kept.groupBy("__pid").agg(F.count("*").alias("n")), "__pid", df.sparkSession))  # a row for each partition
    return kept.join(start, "__pid").select(*df.columns, (F.col("start") + F.col("__pos")).alias(ROW))


def in_order(order: str | list[str] = ROW, by: list[str] | None = None) -> Window:
    """The window of a partition's rows in order; the row number settles ties."""
    keys = [order] if isinstance(order, str) else list(order)
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*keys)

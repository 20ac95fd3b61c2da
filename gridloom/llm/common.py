"""Helpers shared by the training-data operators: scratch tables, word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on one machine (tests), a local folder of our own. On a
    cluster it must be set: what an executor writes to its own disk no other one sees."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared store, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"

    def tidy() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended: the store's owner clears its checkpoint folder
            return

    atexit.register(tidy)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared store and reads it back: lineage is cut, any executor may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._gridloom_path = path
    return back


def unstore(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing will read it again."""
    drop_path(df.sparkSession, df._gridloom_path)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows of hashed words; a shorter sequence counts whole, an empty one gives none."""
    n = len(h)
    if not n:
        return h
    width = min(n, k)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = mix(out * _STEP + h[i : n - width + 1 + i])
    return out


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """Values of a text column, a few at a time, so that a batch is never held twice."""
    col = batch.column(column)
    for at in range(0, len(col), 256):
        yield from col.slice(at, 256).to_pylist()


Batches = Iterator[pa.RecordBatch]


def releasing(task: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The task function, which hands freed memory back to the system when it ends: workers are used again, and what one
    task had at its peak would else count against the next."""

    @functools.wraps(task)
    def run(batches: Batches) -> Batches:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return run


#: Texts vary in length, so batches are kept small; settings of the session come first.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def mapped(df: DataFrame, task: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size, in tasks that hand their memory back."""
    for key, value in _BATCHES.items():
        if df.sparkSession.conf.get(key, None) is None:
            df.sparkSession.conf.set(key, value)
    return df.mapInArrow(releasing(task), schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges (a long, b long)``: ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges stand still. Each step is a
    grouped minimum with partial sums and a join that may be split when skewed; each is written to the shared store.
    No edges give no rows; self loops and repeated edges change nothing.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def sign(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(flat, name)
    last = sign(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each node takes its smallest neighbour, and so do its other neighbours.
        step = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step = stored(step.distinct(), name)
        unstore(now)
        unstore(large)
        now, before, last = step, last, sign(step)
        if last == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
# Bytes of a batch that goes to Python.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_interval(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1) that grows with it."""
    return (F.shiftright(hashed, 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_many_to_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``many`` with the columns of ``one``, which holds each key once; many rows may share one.

    Keys that hold over a thousandth of the rows are fewer than a thousand: their rows of
    ``one`` are broadcast, and only rows of other keys are shuffled. ``many`` is read three
    times, so pass a staged table. A null in a key finds nothing.
    """
    per_key = many.groupBy(*keys).agg(F.count("*").alias("_rows"))
    least = many.count() // 1000 + 1
    hot = F.broadcast(per_key.filter(F.col("_rows") > least).select(*keys, F.lit(True).alias("_hot")))
    marked = many.join(hot, keys, "left")
    few = one.join(hot, keys, "left_semi")
    return marked.filter("_hot").join(F.broadcast(few), keys, how).unionByName(
        marked.filter("_hot is null").join(one, keys, how)
    ).drop("_hot")


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside send Python batches of about ``size`` bytes at most, or of one row.

    Without it a batch has 10,000 rows, however long: tens of MB of texts, of which the JVM
    holds a column and a stream and Python another copy, for every task at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back_memory() -> None:
    """Return what this Python process no longer uses: workers outlive the stages they served."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """A function for ``mapInArrow`` that returns its memory, and drops caches, when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back_memory()

    return wrapped
